"""All pairs of two sides within blocks, for exact answers that need them all: parts of bounded size meet in units of work.

A unit compares its parts by products of small matrices and keeps its best pairs alone, so no rows are made for pairs. The number of
pairs stays that of the two sides multiplied; each row is sent once for every part of the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part, and numbers of one product of a unit.
PART, CELLS = 32768, 1 << 22


def dealt(left: DataFrame, right: DataFrame, on: list[str], rows: int = PART) -> DataFrame:
    """Rows of both sides with i and j, the parts of a unit, and `other`, whether a row is of the right side. Both have one shape and an
    id, by whose hash they are dealt; on: the columns of a block, of which there are few."""
    parts = lambda df, name: F.broadcast(df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows).alias(name)))
    m, k = parts(left, "__m"), parts(right, "__k")
    own = lambda size: F.pmod(F.xxhash64("id"), F.col(size))
    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1))
    a = left.join(m, on).join(k, on).withColumn("i", own("__m")).withColumn("j", every("__k")).withColumn("other", F.lit(False))
    b = right.join(m, on).join(k, on).withColumn("j", own("__k")).withColumn("i", every("__m")).withColumn("other", F.lit(True))
    return a.unionByName(b).drop("__m", "__k")


def _units(df: DataFrame, on: list[str], f, schema: str) -> DataFrame:
    return df.groupBy(*on, "i", "j").applyInArrow(lambda table: f(table), schema)


def _first(group, most: int):
    """Which rows are among the first `most` of their group."""
    import numpy as np

    order = np.argsort(group, kind="stable")
    start = np.searchsorted(group[order], group[order])
    out = np.empty(len(group), bool)
    out[order] = np.arange(len(group)) - start < most
    return out


def _copies(v):
    """The number of its distinct row for every row, and one row of each."""
    import numpy as np

    raw = np.ascontiguousarray(v).view(np.dtype((np.void, max(1, v.shape[1] * v.itemsize)))).ravel() if v.shape[1] else np.zeros(len(v))
    _, one, group = np.unique(raw, return_index=True, return_inverse=True)
    return group.ravel(), one


def nearest_rows(q, w, k: int, least: float):
    """Scores and rows of w, the k best for every row of q: by cosine of 6 digits, then by row; unset ones have row -1. NaN is above all."""
    import numpy as np

    group, one = _copies(q)
    kept = np.flatnonzero(_first(_copies(w)[0], k))  # later copies of a vector are never among the first k
    norm = lambda x: np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = lambda x: np.divide(x, norm(x), out=np.zeros_like(x), where=norm(x) != 0)
    q, w = unit(q[one]), unit(w[kept])
    broken = np.isnan(q).any() or np.isnan(w).any()
    scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
    step = 512
    for x in range(0, len(q), step):
        s, f = scores[x : x + step], found[x : x + step]
        y, width = 0, 16 * k  # the first columns are few, so the bound is near before most are met
        while y < len(w):
            c = q[x : x + step] @ w[y : y + width].T
            if broken:
                c[np.isnan(c)] = np.inf
            low = np.maximum(s[:, -1], least - 1e-6)
            r, n = np.nonzero(c > low[:, None])
            if len(r):
                r, n, c = np.concatenate([r, np.repeat(np.arange(len(s)), k)]), np.concatenate([n + y, f.ravel()]), np.concatenate([np.round(c[r, n], 6) + 0.0, s.ravel()])
                order = np.lexsort((n, -c, r))
                r, n, c = r[order], n[order], c[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                top = rank < k
                s[r[top], rank[top]], f[r[top], rank[top]] = c[top], n[top]
            y, width = y + width, min(4 * width, CELLS // step)
    found = np.where(found >= 0, kept[found] if len(kept) else -1, -1)
    scores[np.isinf(scores) & (found >= 0)] = np.nan
    return scores[group], found[group]


def nearest(queries: DataFrame, items: DataFrame, block: str, k: int, least: float) -> DataFrame:
    """a, b, score: for each query its k nearest items of the same block with at least that cosine. Both: id, v, block.

    Vectors that are null or have a null number have no score; vectors of different lengths do not meet."""
    # a null score comes last and is never enough, so its rows may go at once
    side = lambda df: df.select(F.col(block).alias("block"), F.size("v").alias("d"), "id", "v").filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    def best(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("id")
        other = table["other"].to_numpy(zero_copy_only=False)
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
        q, w = np.flatnonzero(~other), np.flatnonzero(other)
        scores, found = nearest_rows(v[q], v[w], k, least)
        r, c = np.nonzero((found >= 0) & ~(scores < least))
        ids = table["id"]
        return pa.table({"a": ids.take(pa.array(q[r])), "b": ids.take(pa.array(w[found[r, c]])), "score": pa.array(scores[r, c])})

    kinds = (queries.schema["id"].dataType.simpleString(), items.schema["id"].dataType.simpleString())
    p = _units(dealt(side(queries), side(items), ["block", "d"]), ["block", "d"], best, f"a {kinds[0]}, b {kinds[1]}, score double")
    own = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return p.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k).drop("r")


def most_shared(sets: DataFrame, most: int, least: int) -> DataFrame:
    """a, b, shared: the `most` pairs a < b of different teams whose sets share most values, `least` at any rate, then by a and b.

    sets: id (a key), team, v (an array of distinct values in order). Of the ids with one set and team only the first `most` can be
    part of the answer: an id has a better pair with each of them wherever a later one has one."""
    own = Window.partitionBy("v", "team").orderBy("id")
    some = sets.filter((F.size("v") >= least) & F.col("team").isNotNull()).withColumn("r", F.row_number().over(own)).filter(F.col("r") <= most)
    some = some.groupBy("v", "team").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.lit(0).alias("block"), F.col("ids")[0].alias("id"), "ids", "team", "v")

    def best(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("id")
        other = table["other"].to_numpy(zero_copy_only=False)
        v = table["v"].combine_chunks()
        code = v.flatten().dictionary_encode()
        size, end = len(code.dictionary), np.cumsum(v.value_lengths().to_numpy())
        code, begin = code.indices.to_numpy(), end - v.value_lengths().to_numpy()
        ids, team = table["id"].to_numpy(), table["team"].combine_chunks().dictionary_encode().indices.to_numpy()

        def hot(rows):
            out = np.zeros((len(rows), size), np.float32)
            for n, r in enumerate(rows):
                out[n, code[begin[r] : end[r]]] = 1
            return out

        left, right = np.flatnonzero(~other), np.flatnonzero(other)
        step = max(16, min(2048, CELLS // max(1, size)))
        top = (np.empty(0, np.int64),) * 3  # shared, left and right
        ys = [right[y : y + step] for y in range(0, len(right), step)]
        held = [hot(y) for y in ys] if len(right) * size <= 8 * CELLS else None
        for x in range(0, len(left), step):
            a = left[x : x + step]
            h = hot(a)
            for n, b in enumerate(ys):
                if ids[b[-1]] <= ids[a[0]]:
                    continue
                c = h @ (held[n] if held else hot(b)).T
                bound = max(least, top[0][-1] if len(top[0]) == most else 0)
                r, s = np.nonzero(c >= bound)
                c, r, s = c[r, s].astype(np.int64), a[r], b[s]
                ok = (team[r] != team[s]) & (ids[r] < ids[s])
                c, r, s = (np.concatenate([t, u[ok]]) for t, u in zip(top, (c, r, s), strict=True))
                order = np.lexsort((ids[s], ids[r], -c))[:most]
                top = c[order], r[order], s[order]
        out = []
        for c, r, s in zip(*top, strict=True):
            p, q = table["ids"][int(r)].as_py(), table["ids"][int(s)].as_py()
            out += [(-int(c), min(x, y), max(x, y)) for x in p for y in q]
        out = sorted(out)[:most]
        return pa.table({"a": pa.array([r[1] for r in out], pa.int64()), "b": pa.array([r[2] for r in out], pa.int64()), "shared": pa.array([-r[0] for r in out], pa.int64())})

    p = _units(dealt(some, some, ["block"]), ["block"], best, "a long, b long, shared long")
    return p.orderBy(F.desc("shared"), "a", "b").limit(most)
