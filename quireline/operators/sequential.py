"""Operators whose next step depends on what was kept before: one ordered pass in each group.

A group is one book (or one document): its headings, chapters, lines or
candidates, never its text. Groups are independent, so the work spreads over
them; plans that build these frames keep texts out of them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.vector import common_length, similarity


def per_group(df: DataFrame, by: list[str], order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], extra: str = "") -> DataFrame:
    """Sorts each group and hands it to ``step``; the result has the input's columns and ``extra`` ones."""
    schema = T.StructType(list(df.schema.fields))
    for f in T._parse_datatype_string(extra).fields if extra else []:
        schema.add(f)
    return df.groupBy(*by).applyInPandas(lambda g: step(g.sort_values(order, kind="stable").reset_index(drop=True))[schema.names], schema)


def kept_far_apart(at: list[int], gap: int, most: int | None = None) -> list[bool]:
    """Greedy from the left: kept if at least a gap after the last kept one, up to a number."""
    out, last, n = [], None, 0
    for p in at:
        ok = (last is None or p - last >= gap) and (most is None or n < most)
        out.append(ok)
        if ok:
            last, n = p, n + 1
    return out


def downsample(df: DataFrame, by: list[str], at: str, gap: int = 2000, most: int = 80) -> DataFrame:
    return per_group(df, by, [at], lambda g: g[kept_far_apart(g[at].tolist(), gap, most)])


def dedup_headings(df: DataFrame, by: list[str], at: str, kind: str, norm: str, gap: int = 5000) -> DataFrame:
    """A heading goes if the last one *kept* has the same kind and name and is within the gap."""

    def step(g: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], None
        for k, n, p in zip(g[kind], g[norm], g[at], strict=True):
            ok = not (last is not None and n and (k, n) == last[:2] and p - last[2] <= gap)
            keep.append(ok)
            last = (k, n, p) if ok else last
        return g[keep]

    return per_group(df, by, [at], step)


def diverse_top(df: DataFrame, by: list[str], at: str, score: str, apart: int, k: int) -> DataFrame:
    """By falling score, those at least ``apart`` from all picked before, up to k."""

    def step(g: pd.DataFrame) -> pd.DataFrame:
        picked: list[int] = []
        for i, p in enumerate(g[at]):
            if len(picked) < k and all(abs(p - g[at][j]) >= apart for j in picked):
                picked.append(i)
        return g.iloc[picked].assign(rank=range(1, len(picked) + 1))

    negative = df.withColumn("__neg", -df[score])
    return per_group(negative, by, ["__neg", at], step, "rank int").drop("__neg")


def merge_families(df: DataFrame, by: list[str], at: str, family: str, gap: int) -> DataFrame:
    """Families in order of their number; a row goes if an accepted one of an earlier family is within the gap."""

    def step(g: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        keep = []
        for f, p in zip(g[family], g[at], strict=True):
            ok = all(of == f or abs(p - op) > gap for of, op in taken)
            keep.append(ok)
            if ok:
                taken.append((f, p))
        return g[keep]

    return per_group(df, by, [family, at], step)


def fill_gaps(units: list[int | None], first: int, count: int, gap: int = 2, tail: int = 6) -> list[int]:
    """Missing or falling starts are spread evenly between their neighbours; after the last known one the step is the median difference."""
    known, last = [], first - 1
    for u in units:
        ok = u is not None and 0 <= u < count and u > last
        known.append(u if ok else None)
        last = u if ok else last
    have = [u for u in known if u is not None]
    steps = sorted(b - a for a, b in zip(have, have[1:], strict=False))
    tail = max(tail, steps[len(steps) // 2]) if steps else tail
    out, before = [], max(first, 0)
    for i, u in enumerate(known):
        if u is None:
            later = next(((j, v) for j, v in enumerate(known[i:], i) if v is not None), None)
            low = max(first, before + gap)
            if later is None:
                u = low + max(0, tail - gap)
            else:
                left = later[0] - i
                u = low + max(0, later[1] - gap * left - low) // left
            u = max(0, min(count - 1, u))
        out.append(u)
        before = u
    last = first - 1
    for i, u in enumerate(out):
        out[i] = last = u if u > last else min(count - 1, last + gap)
    return out


def gap_fill(df: DataFrame, by: list[str], order: str, unit: str, count: str, first: int = 0) -> DataFrame:
    def step(g: pd.DataFrame) -> pd.DataFrame:
        units = [None if pd.isna(u) else int(u) for u in g[unit]]
        return g.assign(filled=fill_gaps(units, first, int(g[count].iloc[0])))

    return per_group(df, by, [order], step, "filled long")


def merged_lines(lines: list[str]) -> list[str]:
    """Lines that look like entries; a number alone joins the last kept line if that has letters and no number at its end."""
    import re

    letters, ends = re.compile(r"[A-Za-z\u4e00-\u9fff]"), re.compile(r"\d\s*$")
    alone = lambda s: bool(re.fullmatch(r"\d{1,5}|[ivxlcdm]{1,10}", s.lower()))
    rows = [x.strip() for x in lines]
    kept: list[str] = []
    for i, s in enumerate(rows):
        if not s:
            continue
        if alone(s):
            if kept and letters.search(kept[-1]) and not ends.search(kept[-1]):
                kept[-1] += " " + s
            continue
        ahead = next((t for t in rows[i + 1 : i + 4] if t), "")
        low = s.lower()
        entry = "contents" in low or "目录" in s or bool(ends.search(s)) or "…" in s
        entry |= bool(re.match(r"(chapter|part)\b", low)) or bool(re.match(r"\d+(\.\d+)*\b", s) and letters.search(s))
        entry |= bool(ahead) and alone(ahead) and bool(letters.search(s)) and len(s) <= 180
        if entry and (len(s) <= 260 or ends.search(s)):
            kept.append(s)
    return kept


def _worth_matching(left: list[tuple[int | None, str]], right: list[tuple[int | None, str]], most: float, cost: Callable[[tuple, tuple], float], sim: Callable[[str, str], float]) -> list[dict[int, float]]:
    """For each left row the costs of those right rows that a match may pay for: below ``most``, what skipping both costs.

    The titles' similarity is bounded first by the characters they share and then by their longest common subsequence; what cannot
    pay by these bounds is not compared. Another measure than our own has no such bounds.
    """
    import numpy as np

    most += 1e-6
    if sim is not similarity:
        return [{j: c for j, b in enumerate(right) if (c := cost(a, b)) < most} for a in left]
    low = [b[1].lower() for b in right]
    sizes = np.array([len(t) for t in low], dtype=float)
    chars = lambda t: np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % 64, minlength=64)
    held = np.array([chars(t) for t in low]).reshape(-1, 64)
    numbers = np.array([b[0] or 0 for b in right])
    out = []
    for a in left:
        t = a[1].lower()
        high = 2 * np.minimum(held, chars(t)).sum(1) / np.maximum(sizes + len(t), 1)
        apart = 1.5 * ((numbers != 0) & (numbers != a[0])) if a[0] else np.zeros(len(low))
        same = (numbers == a[0]) if a[0] else np.zeros(len(low), dtype=bool)
        near = {}
        for j in np.flatnonzero(same | (10 * (1 - high) + apart < most)).tolist():
            if not same[j] and t != low[j]:
                both = max(1, len(t) + len(low[j]))
                if 10 * (1 - 2 * common_length(t, low[j], both * (1 - (most - apart[j]) / 10) / 2) / both) + apart[j] >= most:
                    continue
            if (c := cost(a, right[j])) < most:
                near[j] = c
        out.append(near)
    return out


def monotone_alignment(left: list[tuple[int | None, str]], right: list[tuple[int | None, str]], skip: float = 2.0, sim: Callable[[str, str], float] = similarity) -> dict[int, int]:
    """Least-cost monotone matching of two sequences of (number, title), either side may skip.

    A match costs ten times the dissimilarity, 1.5 more where the numbers differ and 4 more where the titles have little in
    common; equal numbers on a title that is a number cost at most 0.5. Of equal ends the longer one wins.
    """
    import re

    def cost(a: tuple, b: tuple) -> float:
        s = sim(a[1].lower(), b[1].lower())
        c = 10 * (1 - s) + (1.5 if a[0] and b[0] and a[0] != b[0] else 0)
        if a[0] and a[0] == b[0] and re.fullmatch(r"(?i)\W*(chapter|chap\.?)?\s*(\d{1,3}|[ivxlcdm]+)\W*|第.{1,8}章.*", b[1].strip()):
            return min(c / 10, 0.5)
        return c + (4 if s < 0.25 else 0)

    n, m = len(left), len(right)
    match = _worth_matching(left, right, 2 * skip, cost, sim)
    best = [0.0] * (m + 1)
    for j in range(1, m + 1):
        best[j] = best[j - 1] + skip
    came = [bytearray(m + 1) for _ in range(n + 1)]  # 0: the left one is skipped, 1: the right one, 2: a match
    came[0] = bytearray([1]) * (m + 1)
    for i in range(1, n + 1):
        near, row, before = match[i - 1], came[i], best
        best = [before[0] + skip]
        last = best[0]
        for j in range(1, m + 1):
            up, over = before[j] + skip, last + skip
            last = up
            if over < last:
                last, row[j] = over, 1
            if (c := near.get(j - 1)) is not None and before[j - 1] + c < last:
                last, row[j] = before[j - 1] + c, 2
            best.append(last)
    i, j = n, min(range(m + 1), key=lambda j: (best[j], -j))
    out = {}
    while i or j:
        if came[i][j] == 2:
            out[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif came[i][j] == 0:
            i -= 1
        else:
            j -= 1
    return out


def align(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """J13 for each group: left and right have pos, no, title; gives (by, left_pos, right_pos, score)."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in names})
        a, b = a.sort_values("pos"), b.sort_values("pos")
        rows = lambda d: [(None if pd.isna(x) else int(x), t or "") for x, t in zip(d["no"], d["title"], strict=True)]
        la, lb = rows(a), rows(b)
        got = sorted(monotone_alignment(la, lb).items())
        out = {c: pd.Series([a[c].iloc[0]] * len(got), dtype=object) for c in by}  # object: a string column of pandas' own kind comes in chunks
        out["left_pos"] = pd.Series([int(a["pos"].iloc[i]) for i, _ in got], dtype="int64")
        out["right_pos"] = pd.Series([int(b["pos"].iloc[j]) for _, j in got], dtype="int64")
        out["score"] = pd.Series([similarity(la[i][1].lower(), lb[j][1].lower()) for i, j in got], dtype="float64")
        return pd.DataFrame(out)

    names = [*by, "left_pos", "right_pos", "score"]
    right = right.toDF(*right.columns)  # both sides may come from one table
    schema = ", ".join([*(f"{c} {left.schema[c].dataType.simpleString()}" for c in by), "left_pos long", "right_pos long", "score double"])
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)


def chosen_boundaries(candidates: list[list[tuple[int, float]]], estimates: list[float], length: int, gap: int = 200, least: float = 0.5) -> list[tuple[int, str]]:
    """One boundary a chapter, in order: the most certain candidate beyond the one before, else the estimate, at least a gap further."""
    out: list[tuple[int, str]] = []
    prev = -gap
    for cands, guess in zip(candidates, estimates, strict=True):
        ahead = [(c, -abs(p - guess), p) for p, c in cands if p >= prev + gap and c >= least]
        at, how = (max(ahead)[2], "candidate") if ahead else (int(guess), "estimate")
        at = min(length, max(at, prev + gap, 0))
        out.append((at, how))
        prev = at
    return out


def lock_headings(starts: list[int], headings: list[int], radius: int) -> list[int]:
    """Each start moves to the nearest heading in reach that no earlier start has taken and that keeps the order."""
    from bisect import bisect_right

    heads = sorted(set(headings))
    out, prev = [], -1  # what earlier starts have taken lies at prev or before
    for s in starts:
        first, at = bisect_right(heads, prev), bisect_right(heads, s)
        near = [h for h in (*heads[max(first, at - 1) : at], *heads[max(first, at) : max(first, at) + 1]) if abs(h - s) <= radius]
        prev = min(near, key=lambda h: (abs(h - s), h)) if near else max(s, prev + 1)
        out.append(prev)
    return out


def boundaries(df: DataFrame, by: list[str], order: str, radius: int = 500, gap: int = 200) -> DataFrame:
    """W13, W14 for each book: columns candidates (array of struct(pos, conf)), estimate, length, headings (array)."""

    def step(g: pd.DataFrame) -> pd.DataFrame:
        cands = [[(int(c["pos"]), float(c["conf"])) for c in (row if row is not None else [])] for row in g["candidates"]]
        got = chosen_boundaries(cands, g["estimate"].tolist(), int(g["length"].iloc[0]), gap)
        heads = g["headings"].iloc[0]
        locked = lock_headings([p for p, _ in got], [] if heads is None else [int(h) for h in heads], radius)
        return g.assign(boundary=locked, method=[m for _, m in got])

    return per_group(df, by, [order], step, "boundary long, method string")
