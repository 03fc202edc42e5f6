"""Indices, agreement, stability and diagnostics of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gap2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def as_vector(df: DataFrame, key: str, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(key, cluster, x) with x an array of doubles."""
    return df.select(key, cluster, F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))


def centroids(df: DataFrame, keys: list[str] = ["cluster"]) -> DataFrame:
    """(keys, size, centre) of rows with a vector x: a mean for each dimension in one aggregate."""
    dims = df.agg(F.max(F.size("x"))).first()[0] or 0
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(max(dims, 0)))).alias("centre"))


def calinski_harabasz(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, ch, n, k) by sums of squares of each dimension; null for one cluster or one row each."""
    by = by or []
    cell = df.select(*by, "cluster", F.posexplode("x").alias("d", "v")).groupBy(*by, "cluster", "d").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    dim = cell.groupBy(*by, "d").agg((F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))).alias("within"), (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    total = dim.groupBy(*by).agg(F.sum("within").alias("w"), F.sum("between").alias("b"), F.max("n").alias("n"), F.max("k").alias("k"))
    return total.select(*by, F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("w") > 0), F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("ch"), "n", "k")


def davies_bouldin(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, db): mean over clusters of the worst (scatter + scatter) / distance of centres. Centres are joined in pairs, not rows."""
    by = by or []
    c = centroids(df, [*by, "cluster"])
    spread = df.join(c, [*by, "cluster"]).groupBy(*by, "cluster").agg(F.avg(F.sqrt(gap2(F.col("x"), F.col("centre")))).alias("s"))
    c = c.join(spread, [*by, "cluster"])
    other = c.select(*by, F.col("cluster").alias("other"), F.col("centre").alias("oc"), F.col("s").alias("os"))
    pairs = (c.join(other, by) if by else c.crossJoin(other)).where(F.col("cluster") != F.col("other"))
    worst = pairs.groupBy(*by, "cluster").agg(F.max((F.col("s") + F.col("os")) / F.sqrt(gap2(F.col("centre"), F.col("oc")))).alias("r"))
    return worst.groupBy(*by).agg(F.avg("r").alias("db"))


#: Blocks of a cluster, as long as they hold no more than LARGEST rows: each row asked for is sent to every block.
BLOCKS, LARGEST = 16, 65_536


def blocks_of(size: Column, block: int) -> Column:
    """How many blocks a cluster is dealt over: at first one for each `block` rows, then BLOCKS, so that what is sent grows with the rows."""
    return F.greatest(F.least(F.ceil(size / block), F.lit(BLOCKS)), F.ceil(size / LARGEST)).cast("int")


def rivals(rows: DataFrame, by: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """For rows (by, _k, cluster, x; _w is how many rows it stands for, one if not given): which clusters _t each must be summed against (its own, `_own`, and those that may be nearest), and the clusters.

    The mean distance to a cluster lies between the distance to its centre and the root of the mean squared distance.
    """
    rows = rows if "_w" in rows.columns else rows.withColumn("_w", F.lit(1))
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    weight = F.sum("_w")
    centre = rows.groupBy(*by, "cluster").agg(weight.alias("size"), F.count(F.lit(1)).alias("_rows"), F.array(*(F.sum(F.get("x", F.lit(i)) * F.col("_w")) / weight for i in range(max(dims, 0)))).alias("centre"))
    spread = rows.join(centre, [*by, "cluster"]).groupBy(*by, "cluster").agg((F.sum(gap2(F.col("x"), F.col("centre")) * F.col("_w")) / weight).alias("_v"))
    clusters = centre.join(spread, [*by, "cluster"]).select(*by, F.col("cluster").alias("_t"), F.col("size").alias("_n"), F.col("centre").alias("_m"), "_v", blocks_of(F.col("_rows"), block).alias("_blocks"))
    far = rows.join(clusters, by) if by else rows.crossJoin(clusters)  # a row for each cluster, of which there are few
    # Slightly wider bounds, for the rounding of sums.
    far = far.withColumn("_d2", gap2(F.col("x"), F.col("_m"))).withColumns({"_low": F.sqrt("_d2") * (1 - 1e-9) - 1e-12, "_high": F.sqrt(F.col("_d2") + F.col("_v")) * (1 + 1e-9) + 1e-12})
    own = F.col("cluster") == F.col("_t")
    best = far.groupBy(*by, "_k").agg(F.min(F.when(~own, F.col("_high"))).alias("_best"))
    return far.join(best, [*by, "_k"]).where(own | (F.col("_low") <= F.col("_best"))).select(*by, "_k", "_w", "_t", "x", own.alias("_own"), "_n", "_blocks"), clusters


def silhouette(df: DataFrame, key: str, by: list[str] | None = None, block: int = 512) -> DataFrame:
    """(by, silhouette, n): exact; rows alone in their cluster count 0, and without a second cluster it is null. key is unique (within by).

    Most foreign clusters are settled by their moments (see rivals); distances are summed against the row's own cluster and those that
    may be nearest, mostly one. Rows travel and are compared in blocks of one cluster; equal rows of a cluster are one row with its number.
    """
    import numpy as np
    import pyarrow as pa

    from .order import cut

    by = by or []
    rows = cut(df.groupBy(*by, "cluster", "x").agg(F.min(key).alias("_k"), F.count(F.lit(1)).alias("_w")))
    asks, clusters = rivals(rows, by, block)
    slot = F.pmod(F.xxhash64("_k"), F.col("_blocks"))
    held = rows.withColumnRenamed("cluster", "_t").join(clusters.select(*by, "_t", "_blocks"), [*by, "_t"])
    held = held.groupBy(*by, "_t", slot.cast("int").alias("_b")).agg(F.collect_list(F.struct("x", "_w")).alias("_y"))  # about `block` rows
    packed = asks.groupBy(*by, "_t", "_blocks", slot.alias("_a")).agg(F.collect_list(F.struct("_k", "x")).alias("_x"))
    met = packed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).join(held, [*by, "_t", "_b"])

    def gaps(x, y):
        """Squared distances. With many dimensions by a product of matrices around y's mean; pairs so near that this loses digits are taken again."""
        if x.shape[1] <= 8:
            out = np.zeros((len(x), len(y)))
            for d in range(x.shape[1]):
                gap = x[:, d, None] - y[None, :, d]
                gap *= gap
                out += gap
            return out
        u, v = x - y.mean(0), y - y.mean(0)
        long = (u * u).sum(1)[:, None] + (v * v).sum(1)[None]
        gap = long - 2 * (u @ v.T)
        near = np.nonzero(~(gap > 1e-5 * long))
        gap[near] = sum((x[near[0], d] - y[near[1], d]) ** 2 for d in range(x.shape[1]))
        return gap

    def sums(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                asked, told = one.column("_x").flatten(), one.column("_y").flatten()
                x = np.asarray(asked.field("x").flatten(), float).reshape(len(asked), -1)
                y, w = np.asarray(told.field("x").flatten(), float).reshape(len(told), -1), np.asarray(told.field("_w"), float)
                total = np.zeros(len(x))
                for at in range(0, len(x), 256):
                    for of in range(0, len(y), 1024):
                        gap = gaps(x[at : at + 256], y[of : of + 1024])
                        total[at : at + 256] += np.sqrt(gap, out=gap) @ w[of : of + 1024]
                again = pa.array(np.zeros(len(x), np.int32))
                yield pa.RecordBatch.from_arrays([*(one.column(c).take(again) for c in (*by, "_t")), asked.field("_k"), pa.array(total)], names=[*by, "_t", "_k", "_sum"])

    kinds = dict(rows.dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"_t {kinds['cluster']}", f"_k {kinds['_k']}", "_sum double"])
    told = met.select(*by, "_t", "_x", "_y").mapInArrow(sums, shape).groupBy(*by, "_k", "_t").agg(F.sum("_sum").alias("_sum"))
    each = asks.drop("x", "_blocks").join(told, [*by, "_k", "_t"])
    each = each.groupBy(*by, "_k", "_w").agg(F.max(F.when(F.col("_own") & (F.col("_n") > 1), F.col("_sum") / (F.col("_n") - 1))).alias("a"), F.min(F.when(~F.col("_own"), F.col("_sum") / F.col("_n"))).alias("b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    known = F.coalesce(F.sum(F.when(s.isNotNull(), F.col("_w"))), F.lit(0))
    return each.groupBy(*by).agg((F.sum(s * F.col("_w")) / F.sum(F.when(s.isNotNull(), F.col("_w")))).alias("silhouette"), known.alias("n"))


def squared_silhouette(df: DataFrame, key: str) -> DataFrame:
    """(silhouette2, n): with squared distances, whose means follow from the sums of each cluster; linear in the rows. key is unique."""
    sums = df.select("cluster", F.posexplode("x").alias("d", "v")).groupBy("cluster", "d").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    c = sums.groupBy(F.col("cluster").alias("_oc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda v: v["s"]).alias("s"), F.sum("q").alias("q"), F.max("n").alias("n"))
    dot = F.aggregate(F.zip_with("x", "s", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    total = F.col("n") * norm + F.col("q") - 2 * dot
    own = F.col("cluster") == F.col("_oc")
    each = df.join(c, F.lit(True)).groupBy(key, "cluster").agg(F.max(F.when(own & (F.col("n") > 1), total / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, total / F.col("n"))).alias("b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(s).alias("silhouette2"), F.count(s).alias("n"))


def agreement(labels: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index of two label columns, by pair counts of the contingency table."""
    return agreement_of_counts(labels.groupBy(*(keys or []), a, b).agg(F.count(F.lit(1)).alias("n")), a, b, keys)


def agreement_of_counts(cell: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index of a contingency table (keys, a, b, n)."""
    keys = keys or []
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    rows = cell.groupBy(*keys, a).agg(F.sum("n").alias("n"))
    cols = cell.groupBy(*keys, b).agg(F.sum("n").alias("n"))
    parts = cell.groupBy(*keys).agg(F.sum(two("n")).alias("c"), F.sum("n").alias("n"))
    r, q = rows.groupBy(*keys).agg(F.sum(two("n")).alias("r")), cols.groupBy(*keys).agg(F.sum(two("n")).alias("q"))
    j = parts.join(r, keys).join(q, keys) if keys else parts.crossJoin(r).crossJoin(q)
    expected, top = F.col("r") * F.col("q") / two("n"), (F.col("r") + F.col("q")) / 2
    return j.select(*keys, F.when(top == expected, 1.0).otherwise((F.col("c") - expected) / (top - expected)).alias("ari"), "n")


def run_contingency(runs: DataFrame, key: str = "id", by: list[str] | None = None) -> DataFrame:
    """(by, run_a, run_b, a, b, n) of every pair of runs run_a < run_b (run, id, cluster): how many rows carry labels a and b.

    Each row becomes the list of its labels; a task multiplies its rows' indicators of (run, label) by themselves and adds the products
    up, so what leaves it is bounded by (runs x labels) squared and no row meets another run's rows in a join.
    """
    import numpy as np
    import pyarrow as pa

    by = by or []
    pair = F.struct(F.col("run").cast("long").alias("r"), F.col("cluster").cast("long").alias("c"))
    rows = runs.where("run is not null and cluster is not null").groupBy(*by, key).agg(F.collect_list(pair).alias("_l")).select(*by, F.xxhash64(*by).alias("_g") if by else F.lit(0).cast("long").alias("_g"), "_l")

    def count(batches):
        held: dict[int, tuple] = {}  # group: (its keys, {(run, label): place}, products)
        for batch in batches:
            lists = batch.column("_l")
            pairs = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            run, label = (np.asarray(pairs.field(f)) for f in ("r", "c"))
            group = np.asarray(batch.column("_g"))
            for g in np.unique(group).tolist():
                mine = np.flatnonzero(group == g)
                inside = np.flatnonzero(group[row] == g)
                keys, places, products = held.get(g) or ([batch.column(c).slice(int(mine[0]), 1) for c in by], {}, np.zeros((0, 0), np.int64))
                both, code = np.unique(np.stack([run[inside], label[inside]]), axis=1, return_inverse=True)
                of = np.array([places.setdefault((int(r), int(c)), len(places)) for r, c in both.T], np.int64)
                if len(places) > len(products):
                    wider = np.zeros((len(places), len(places)), np.int64)
                    wider[: len(products), : len(products)] = products
                    products = wider
                for at in range(0, len(mine), 4096):
                    some = inside[(row[inside] >= mine[at]) & (row[inside] <= mine[min(at + 4096, len(mine)) - 1])]
                    hot = np.zeros((min(4096, len(mine) - at), len(places)), np.float64)
                    hot[np.searchsorted(mine, row[some]) - at, of[code.ravel()[np.searchsorted(inside, some)]]] = 1
                    products += (hot.T @ hot).astype(np.int64)
                held[g] = (keys, places, products)
        for keys, places, products in held.values():
            names = np.array(list(places), np.int64).reshape(-1, 2)
            i, j = np.nonzero(products)
            up = names[i, 0] < names[j, 0]
            i, j = i[up], j[up]
            again = pa.array(np.zeros(len(i), np.int32))
            yield pa.RecordBatch.from_arrays([*(k.take(again) for k in keys), *(pa.array(v) for v in (names[i, 0], names[j, 0], names[i, 1], names[j, 1], products[i, j]))], names=[*by, "run_a", "run_b", "a", "b", "n"])

    kinds = dict(runs.dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "run_a long, run_b long, a long, b long, n long"])
    return rows.mapInArrow(count, shape).groupBy(*by, "run_a", "run_b", "a", "b").agg(F.sum("n").alias("n"))


def run_agreement(runs: DataFrame, key: str = "id", least: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, run_a, run_b, ari, n) of every pair of runs (run, id, cluster) of one group, on the rows both hold, at least `least`."""
    from .order import cut

    by = by or []
    cells = cut(run_contingency(runs, key, by))
    return agreement_of_counts(cells, "a", "b", [*by, "run_a", "run_b"]).where(F.col("n") >= least)


def against_first(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, mean_first, min_first): agreement of the other runs with the first one, of run_agreement's rows."""
    by = by or []
    first = pairs.groupBy(*by).agg(F.min("run_a").alias("run_a"))
    own = pairs.join(first, [*by, "run_a"]) if by else pairs.join(first, "run_a")
    return own.groupBy(*by).agg(F.avg("ari").alias("mean_first"), F.min("ari").alias("min_first"))


def spread(pairs: DataFrame, value: str = "ari", by: list[str] | None = None) -> DataFrame:
    """Mean, median and the like of a few values, or of those of each group."""
    x = F.col(value)
    return pairs.groupBy(*(by or [])).agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.expr(f"percentile({value}, 0.1)").alias("p10"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n_pairs"))


def subsamples(ids: DataFrame, key: str, runs: int, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(run, id): for each run the floor(share * n) rows with the least hash of (run, id)."""
    from .order import positions

    n = ids.count()
    rows = ids.select(key).crossJoin(F.broadcast(ids.sparkSession.range(runs).select(F.col("id").cast("int").alias("run"))))
    placed = positions(rows.withColumn("_h", F.xxhash64(F.lit(seed), "run", key)), ["run", "_h", key], "_p")
    return placed.where(F.col("_p") - F.col("run") * n <= int(share * n)).select("run", key)


#: Rows of all, and rows asked for, that one step of a comparison of pairs holds; and pairs that a task is to compare.
TOLD, ASKED, PAIRS = 2048, 256, 4_194_304


def _pairs(asked: DataFrame, told: DataFrame, shape: str, compare) -> DataFrame:
    """Rows asked for beside all rows (both id, v), in blocks of either: compare(ids, values, ids, values) gives batches of pairs, which are not shuffled.

    The blocks asked for go to every block of the rest; at most about `TOLD` rows are one block, so what is sent is the rows asked for times the blocks.
    Both sides are dealt over tasks, so that a task has about `PAIRS` pairs however many rows are asked for.
    """
    n, m = told.count(), asked.count()

    def blocks(df: DataFrame, rows: int, size: int, parts: int, names: tuple[str, str]) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows // size))))
        held = df.groupBy(at.alias("_at")).agg(F.collect_list(F.struct("id", "v")).alias("_l")).repartitionByRange(parts, "_at")
        return held.select(F.col("_l.id").alias(names[0]), F.col("_l.v").alias(names[1]))

    # Blocks of all rows are few in a few tasks, however many the rows: their number, not that of the pairs, grows what is sent.
    size = max(TOLD, -(-n // 256))
    count = min(256, max(1, -(-n // size)))
    parts = min(max(1, -(-m // ASKED)), max(-(-32 // count), -(-n * m // (count * PAIRS))))
    left, right = blocks(asked, m, ASKED, parts, ("_ia", "_va")), blocks(told, n, size, count, ("_ib", "_vb"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from compare(*(batch.column(c).slice(i, 1).flatten() for c in ("_ia", "_va", "_ib", "_vb")))

    return right.crossJoin(left).select("_ia", "_va", "_ib", "_vb").mapInArrow(run, shape)


def coclustering(runs: DataFrame, key: str = "id", wanted: Column | None = None) -> DataFrame:
    """(id_a, id_b, together, n_runs): share of the runs holding both in which both have one label; a row with itself counts too.

    wanted: the rows asked for (over key), held against all rows. Without it every pair id_a <= id_b is given, which grows with the square of the rows.
    Each row becomes the list of its labels by run; (run, id) is unique. Pairs are compared in blocks and come out once, so none is shuffled.
    """
    import numpy as np
    import pyarrow as pa

    from .order import cut

    kind = dict(runs.dtypes)[key]
    rows = cut(runs.where(F.col("run").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct(F.col("run").cast("long").alias("r"), F.col("cluster").cast("long").alias("c"), F.col("cluster").isNull().alias("z"))).alias("v")))
    asked = rows if wanted is None else rows.join(runs.where(wanted).select(F.col(key).alias("id")).distinct(), "id", "left_semi")

    every = wanted is None

    def compare(ia, va, ib, vb):
        def hot(v):
            """Row, run and label of each entry, and whether the label is null."""
            flat = v.flatten()
            row, r, c, z = np.repeat(np.arange(len(v)), np.diff(np.asarray(v.offsets))), *(flat.field(f).to_numpy(zero_copy_only=False) for f in ("r", "c", "z"))
            return row, r, np.where(z, 0, c), z.astype(bool)

        a, b = hot(va), hot(vb)
        run = np.unique(np.concatenate([a[1], b[1]]))
        known = [~x[3] for x in (a, b)]
        labels = np.unique(np.stack([np.concatenate([x[1][k] for x, k in zip((a, b), known)]), np.concatenate([x[2][k] for x, k in zip((a, b), known)])]), axis=1) if any(k.any() for k in known) else np.zeros((2, 0), np.int64)
        place = {(int(p), int(q)): i for i, (p, q) in enumerate(labels.T)}
        held, each, same = [], [], []
        for (row, r, c, _), k, n in ((a, known[0], len(va)), (b, known[1], len(vb))):
            there, sure, label = np.zeros((n, len(run)), np.float32), np.zeros((n, len(run)), np.float32), np.zeros((n, len(place)), np.float32)
            at = np.searchsorted(run, r)
            there[row, at] = 1
            sure[row[k], at[k]] = 1
            label[row[k], [place[int(p), int(q)] for p, q in zip(r[k], c[k])]] = 1
            held.append(there), each.append(sure), same.append(label)
        n_runs, n_sure, together = (x[0] @ x[1].T for x in (held, each, same))
        ok = n_runs > 0
        if every:
            right = ib.to_pylist()
            ok &= np.array([[x <= y for y in right] for x in ia.to_pylist()])
        for i in range(len(ia)):
            j = np.flatnonzero(ok[i])
            share = np.divide(together[i, j].astype(float), n_sure[i, j], out=np.zeros(len(j)), where=n_sure[i, j] > 0)
            yield pa.RecordBatch.from_arrays([ia.take(pa.array(np.full(len(j), i))), ib.take(pa.array(j)), pa.array(share, mask=n_sure[i, j] == 0), pa.array(n_runs[i, j].astype(np.int64))], names=["id_a", "id_b", "together", "n_runs"])

    return _pairs(asked, rows, f"id_a {kind}, id_b {kind}, together double, n_runs long", compare)


def distances(df: DataFrame, key: str, wanted: Column | None = None) -> DataFrame:
    """(id_a, id_b, distance) of rows with a vector x: those wanted against all others; without it every pair id_a < id_b. key is unique.

    Pairs are compared in blocks of rows, and none is shuffled.
    """
    import numpy as np
    import pyarrow as pa

    from .order import cut

    kind = dict(df.dtypes)[key]
    rows = cut(df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.transform("x", lambda v: v.cast("double")).alias("v")))
    asked = rows if wanted is None else rows.join(df.where(wanted).select(F.col(key).alias("id")), "id", "left_semi")

    every = wanted is None

    def matrix(v):
        """The vectors, and which of them are whole: null ones and those with a null component have null distances."""
        ok, flat = v.is_valid().to_numpy(zero_copy_only=False), v.flatten()
        out, lost = (np.zeros((len(v), len(flat) // max(int(ok.sum()), 1)), t) for t in (float, bool))
        out[ok], lost[ok] = flat.to_numpy(zero_copy_only=False).reshape(int(ok.sum()), -1), flat.is_null().to_numpy(zero_copy_only=False).reshape(int(ok.sum()), -1)
        return out, ok & ~lost.any(1)

    def compare(ia, va, ib, vb):
        (xs, whole), (y, other_whole) = matrix(va), matrix(vb)
        y, left, right = np.ascontiguousarray(y.T), ia.to_pylist(), ib.to_pylist()
        for i, x in enumerate(xs):
            gap = np.zeros(len(right))
            if whole[i] and other_whole.any():
                for d, v in enumerate(x):
                    gap += (v - y[d]) ** 2
            j = np.array([p for p, other in enumerate(right) if (left[i] < other if every else left[i] != other)], np.int64)
            yield pa.RecordBatch.from_arrays([ia.take(pa.array(np.full(len(j), i))), ib.take(pa.array(j)), pa.array(np.sqrt(gap[j]), mask=~(other_whole[j] & whole[i]))], names=["id_a", "id_b", "distance"])

    return _pairs(asked, rows, f"id_a {kind}, id_b {kind}, distance double", compare)


def label_ordered(pairs: DataFrame, labels: DataFrame, value: str, key: str = "id") -> DataFrame:
    """(row, col, cluster_a, cluster_b, value): the cells of a pair matrix in the order of (cluster, id), as a heat map wants them. labels: id, cluster."""
    from .order import positions

    at = positions(labels.select(key, "cluster"), ["cluster", key], "_p")
    side = lambda s, place: at.select(F.col(key).alias(f"id_{s}"), F.col("cluster").alias(f"cluster_{s}"), F.col("_p").alias(place))
    return pairs.join(side("a", "row"), "id_a").join(side("b", "col"), "id_b").select("row", "col", "cluster_a", "cluster_b", value)


def interpretation(profiles: DataFrame, n: int = 5) -> DataFrame:
    """(cluster, text): the n features that stand highest above and lowest below the grand mean, in words."""
    from pyspark.sql import Window

    up, down = (F.row_number().over(Window.partitionBy("cluster").orderBy(o, "feature")) for o in (F.desc_nulls_last("z_value"), F.asc_nulls_last("z_value")))
    word = F.format_string("%s (%+.2f)", "feature", "z_value")
    rows = profiles.where(F.col("z_value").isNotNull()).withColumns({"_up": up, "_down": down, "_w": word})
    pick = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= n, F.struct(c, "_w")))), lambda s: s["_w"]), ", ")
    return rows.groupBy("cluster").agg(F.concat(F.lit("high: "), pick("_up"), F.lit("; low: "), pick("_down")).alias("text"))


def profile(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, feature, mean, z): means of the features, and their distance from the grand mean in population deviations."""
    from .rank import long_features

    rows = long_features(df, [cluster], columns)
    grand = rows.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return rows.groupBy(cluster, "feature").agg(F.avg("value").alias("mean_value")).join(grand, "feature").select(cluster, "feature", "mean_value", ((F.col("mean_value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))).alias("z_value"))


def telling_features(profiles: DataFrame, n: int = 5) -> DataFrame:
    """Features whose means vary most over clusters."""
    return profiles.groupBy("feature").agg(F.var_samp("mean_value").alias("var_means")).orderBy(F.desc_nulls_last("var_means"), "feature").limit(n)


def discriminability(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(feature, f, eta2, df1, df2): one-way analysis of variance of each feature."""
    from .rank import long_features

    cell = long_features(df, [cluster], columns).where("value is not null").groupBy("feature", cluster).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count(F.lit(1)).alias("n"))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    within = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    got = cell.groupBy("feature").agg(between.alias("b"), within.alias("w"), (F.count(F.lit(1)) - 1).alias("df1"), (F.sum("n") - F.count(F.lit(1))).alias("df2"))
    return got.select("feature", ((F.col("b") / F.col("df1")) / (F.col("w") / F.col("df2"))).alias("f"), (F.col("b") / (F.col("b") + F.col("w"))).alias("eta2"), "df1", "df2")


def distance_outliers(df: DataFrame, key: str, limit: float = 2.5) -> DataFrame:
    """(key, cluster, distance, z, size, outlier): distance from the own centre, standardised inside the cluster (0 without spread)."""
    from .series import group_z

    d = df.join(centroids(df), "cluster").select(key, "cluster", "size", F.sqrt(gap2(F.col("x"), F.col("centre"))).alias("distance"))
    return group_z(d, "distance", ["cluster"]).select(key, "cluster", "distance", "z", "size", (F.col("z") > limit).alias("outlier"))


def tiny_members(df: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(key, cluster, size) of rows in clusters of `most` rows at most."""
    few = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= most)
    return df.join(few, "cluster").select(key, "cluster", "size")


def tiny_causes(df: DataFrame, most: int = 6) -> DataFrame:
    """(cluster, size, nearest, ratio, cause) of small clusters: distance of the nearest other centre over the mean of all pairs of centres."""
    c = centroids(df)
    o = c.select(F.col("cluster").alias("other"), F.col("centre").alias("oc"))
    pairs = c.join(o, F.col("cluster") != F.col("other")).withColumn("d", F.sqrt(gap2(F.col("centre"), F.col("oc"))))
    mean = pairs.agg(F.avg("d").alias("mean_d"))
    near = pairs.groupBy("cluster", "size").agg(F.min(F.struct("d", "other")).alias("n"))
    ratio = F.col("n.d") / F.col("mean_d")
    cause = F.when(ratio < 0.5, "borderline").when(ratio > 1.5, "outlier").otherwise("distinct")
    return near.where(F.col("size") <= most).crossJoin(F.broadcast(mean)).select("cluster", "size", F.col("n.other").alias("nearest"), ratio.alias("ratio"), cause.alias("cause"))


def sizes_text(df: DataFrame, keys: list[str], cluster: str = "cluster") -> DataFrame:
    """(keys, sizes): "C0:45, C1:83"."""
    n = df.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("n"))
    named = F.transform(F.array_sort(F.collect_list(F.struct(cluster, "n"))), lambda s: F.concat(F.lit("C"), s[cluster].cast("string"), F.lit(":"), s["n"].cast("string")))
    return n.groupBy(*keys).agg(F.array_join(named, ", ").alias("sizes"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def mark_usable(candidates: DataFrame, least_size: int = 10, least_ari: float = 0.60) -> DataFrame:
    """candidates with `usable`: clusters large enough, and runs that agree where that is known."""
    ok = (F.col("min_size") >= least_size) & (F.col("ari").isNull() | (F.col("ari") >= least_ari))
    return candidates.withColumn("usable", F.coalesce(ok, F.lit(False)))


def usable(candidates: DataFrame, least_size: int = 10, least_ari: float = 0.60) -> DataFrame:
    """Usable candidates, or all of them where none is."""
    marked = mark_usable(candidates, least_size, least_ari)
    some = marked.agg(F.max("usable").alias("_any"))
    return marked.join(some, F.col("usable") | ~F.coalesce("_any", F.lit(False))).drop("_any")


def indices(labelled: DataFrame, by: list[str] = ["run"], key: str = "id") -> DataFrame:
    """(by, silhouette, ch, db, sizes, min_size, max_size) of many partitions (by, id, cluster, x) at once."""
    out = sizes_text(labelled, by)
    for part in (silhouette(labelled, key, by).select(*by, "silhouette"), calinski_harabasz(labelled, by).select(*by, "ch"), davies_bouldin(labelled, by)):
        out = out.join(part, by, "left")
    return out
