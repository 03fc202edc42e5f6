"""The study from staging tables to reports: build the subject matrix, cluster it, test what the clusters differ in."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cluster, inference, linear, phase, rank, scale, validity
from ..operators.order import cut
from ..sources.recordings import append_row, config_hash, log_run, write_tables

# Features of the blocks of the subject matrix.
BLOCKS = {
    "PHY": ["hr_sd", "eda_sd", "st_sd", "pulse_sd"],
    "PSY": ["tsv_sd", "tcv_sd"],
    "BHR": ["gap_mean", "gap_sd"],
    "TLX": ["tlx_sd"],
    "EUP": ["eup_m", "eup_p"],
}


@dataclass
class Config:
    structure: str = "full"
    ks: tuple[int, ...] = (2, 3, 4, 5, 6)
    kinds: tuple[str, ...] = ("spherical", "diag", "tied", "full")
    n_init: int = 30
    seed: int = 42
    seed_runs: int = 30
    subsample_runs: int = 100
    share: float = 0.8
    alpha: float = 0.05
    mixture_init: int = 10
    n_perm: int = 5000
    #: Write distances and co-clustering of all pairs of subjects, which grow with their square.
    pair_tables: bool = True
    blocks: dict = field(default_factory=lambda: dict(BLOCKS))
    #: Sets of continuous traits {mode: traits} that are tested apart; without it all traits are one set.
    trait_sets: dict = field(default_factory=dict)


def long_features(minute: DataFrame, survey: DataFrame, load: DataFrame, traits: DataFrame) -> DataFrame:
    """(id, feature, value) of all blocks.

    minute(id, env, feature, minute, value); survey(id, env, time_min, tsv, tcv, p, m), load(id, env, score), traits(id, m, p, row):
    env of the last two may be a segment, which stands for a condition and a phase.
    """
    named = minute.where(F.col("id").isNotNull()).withColumn("cond", C.condition(F.col("env"))).where("cond is not null")
    means = phase.phase_means(named, ["id", "feature", "cond"], C.minute_phase(F.col("minute")))
    parts = [means.groupBy("id", "feature").agg(F.stddev_samp("delta").alias("value")).withColumn("feature", F.concat("feature", F.lit("_sd")))]
    s = survey.where(F.col("id").isNotNull()).withColumn("cond", C.condition(F.col("env")))
    for name in ("tsv", "tcv"):
        parts.append(phase.point_difference(s, "id", "cond", "time_min", 10, 20, F.col(name)).select("id", F.lit(f"{name}_sd").alias("feature"), F.col("delta_sd").alias("value")))
    gap = phase.dispersion(s, "id", "cond", F.col("m") - F.col("p"))
    parts += [gap.select("id", F.lit("gap_mean").alias("feature"), F.col("mean_env").alias("value")), gap.select("id", F.lit("gap_sd").alias("feature"), F.col("sd_env").alias("value"))]
    t = load.where(F.col("id").isNotNull()).withColumns({"cond": C.condition(F.col("env")), "phase": C.segment_phase(F.col("env"))})
    parts.append(phase.reactivity(t, "id", "cond", F.col("phase"), "score").select("id", F.lit("tlx_sd").alias("feature"), F.col("reactivity_sd").alias("value")))
    known = phase.first_known(traits.where(F.col("id").isNotNull()), ["id"], ["m", "p"], "row")
    parts += [known.select("id", F.lit(f"eup_{c}").alias("feature"), F.col(c).cast("double").alias("value")) for c in ("m", "p")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("id", "feature", "value"))
    return out.select("id", "feature", "value")


def subject_matrix(features: DataFrame, config: Config = Config()) -> DataFrame:
    """One row for each id: the chosen blocks side by side, imputed by means and scaled so that blocks weigh alike."""
    blocks = scale.chosen_blocks(config.blocks, config.structure)
    names = [c for b in blocks.values() for c in b]
    wide = features.groupBy("id").agg(*(F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in names))
    return cut(scale.block_standardise(scale.impute(cut(wide), names), blocks))


def candidates(x: DataFrame, names: list[str], config: Config = Config()) -> tuple[DataFrame, dict[str, cluster.Solution]]:
    """(key, model, k, kind, indices, sizes) of every model of the grid, and the solutions by key."""
    found: dict[str, cluster.Solution] = {f"kmeans_k{s.k}": s for s in cluster.kmeans_many(x, "id", names, list(config.ks), config.n_init, config.seed)}
    found |= {f"ward_k{k}": cluster.ward(x, "id", names, k) for k in config.ks}
    found |= {f"gmm_k{s.k}_{s.extra['kind']}": s for s in cluster.mixtures(x, "id", names, [(k, kind) for k in config.ks for kind in config.kinds], config.mixture_init, config.seed)}
    every = None
    for key, s in found.items():
        one = s.labels.select(F.lit(key).alias("key"), "id", "cluster")
        every = one if every is None else every.unionByName(one)
    vectors = x.select("id", F.array(*(F.col(c).cast("double") for c in names)).alias("x"))
    facts = [(key, s.model, s.k, s.extra.get("kind"), s.extra.get("bic"), s.extra.get("aic")) for key, s in found.items()]
    facts = x.sparkSession.createDataFrame(facts, "key string, model string, k int, kind string, bic double, aic double")
    scored = validity.indices(cut(every.join(vectors, "id")), ["key"])
    return cut(facts.join(scored, "key").select(*facts.columns, "silhouette", "ch", "db", "sizes", "min_size", "max_size")), found


def _partitions(x: DataFrame, names: list[str], specs: dict[int, tuple[str, int, str | None, int]], config: Config, picks: cluster.Picks | None) -> DataFrame:
    """(run, id, cluster) of k-means and mixtures {run: (model, k, kind, seed)}: all of a model advance together."""
    kmeans = {r: (k, seed) for r, (model, k, _, seed) in specs.items() if model == "kmeans"}
    gmm = {r: (k, kind, seed) for r, (model, k, kind, seed) in specs.items() if model == "gmm"}
    parts = []
    if kmeans:
        parts.append(cluster.kmeans_runs(x, "id", names, kmeans, config.n_init, subsamples=picks))
    if gmm:
        parts.append(cluster.mixture_runs(x, "id", names, gmm, config.mixture_init, subsamples=picks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seed_runs(x: DataFrame, names: list[str], candidates: dict[str, tuple[str, int, str | None]], config: Config = Config(), first_seed: int = 100, n_runs: int | None = None) -> DataFrame:
    """(key, run, id, cluster): each k-means and mixture {key: (model, k, kind)} fitted from seeds first_seed on. Ward has no seed."""
    n = n_runs or config.seed_runs
    keys = [k for k, v in candidates.items() if v[0] != "ward"]
    if not keys:
        return x.sparkSession.createDataFrame([], "key string, run int, id " + dict(x.dtypes)["id"] + ", cluster int")
    specs = {i * n + r: (*candidates[k], first_seed + r) for i, k in enumerate(keys) for r in range(n)}
    of = x.sparkSession.createDataFrame([(i * n + r, k, r) for i, k in enumerate(keys) for r in range(n)], "run int, key string, _r int")
    return _partitions(x, names, specs, config, None).join(F.broadcast(of), "run").select("key", F.col("_r").alias("run"), "id", F.col("cluster").cast("int").alias("cluster"))


def subsample_runs(x: DataFrame, names: list[str], candidates: dict[str, tuple[str, int, str | None]], config: Config = Config(), first_seed: int = 1000) -> DataFrame:
    """(key, run, id, cluster): each candidate fitted on config.subsample_runs draws of config.share of the rows, the same draws for all."""
    n = config.subsample_runs
    limits = cluster.subsample_limits(x.select("id"), "id", n, config.share, config.seed)
    keys = [k for k, v in candidates.items() if v[0] != "ward"]
    out = None
    if keys:
        specs = {i * n + r: (*candidates[k], first_seed + r) for i, k in enumerate(keys) for r in range(n)}
        of = x.sparkSession.createDataFrame([(i * n + r, k, r) for i, k in enumerate(keys) for r in range(n)], "run int, key string, _r int")
        picks = cluster.Picks("id", config.seed, {run: limits[run % n] for run in specs})
        out = _partitions(x, names, specs, config, picks).join(F.broadcast(of), "run").select("key", F.col("_r").alias("run"), "id", F.col("cluster").cast("int").alias("cluster"))
    for key, (model, k, _) in candidates.items():
        if model == "ward":
            picks = validity.subsamples(x.select("id"), "id", n, config.share, config.seed)
            own = cluster.ward_runs(x.join(picks, "id"), "id", names, k).select(F.lit(key).alias("key"), "run", "id", F.col("cluster").cast("int").alias("cluster"))
            out = own if out is None else out.unionByName(own)
    return out


def stability(x: DataFrame, names: list[str], candidates: dict[str, tuple[str, int, str | None]], config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(statistics by key, the subsample runs): agreement over seeds (with the first one, and in pairs) and over subsamples. Ward's seeds agree fully."""
    spark = x.sparkSession
    seeds = cut(validity.run_agreement(cut(seed_runs(x, names, candidates, config)), "id", 1, ["key"]))
    own = validity.spread(seeds, by=["key"]).select("key", F.col("mean").alias("seed_ari"), F.col("sd").alias("seed_ari_sd")).join(validity.against_first(seeds, ["key"]).select("key", F.col("mean_first").alias("seed_ari_first"), F.col("min_first").alias("seed_ari_first_min")), "key")
    fixed = spark.createDataFrame([(k, 1.0, 0.0, 1.0, 1.0) for k, v in candidates.items() if v[0] == "ward"], own.schema)
    runs = cut(subsample_runs(x, names, candidates, config))
    ks = spark.createDataFrame([(k, v[1]) for k, v in candidates.items()], "key string, k int")
    pairs = validity.run_agreement(runs, "id", 1, ["key"]).join(F.broadcast(ks), "key").where(F.col("n") >= F.greatest(F.lit(10), 2 * F.col("k")))
    part = validity.spread(pairs, by=["key"]).select("key", F.col("mean").alias("ari"), F.col("median").alias("ari_median"), F.col("p10").alias("ari_p10"), F.col("min").alias("ari_min"), F.col("sd").alias("ari_sd"), "n_pairs")
    every = spark.createDataFrame([(k,) for k in candidates], "key string")
    return cut(every.join(own.unionByName(fixed), "key", "left").join(part, "key", "left")), runs


def restart_stability(x: DataFrame, names: list[str], model: str, k: int, kind: str | None = None, config: Config = Config(), n_runs: int = 20) -> DataFrame:
    """Spread of the agreement of n_runs fits of one start each."""
    once = replace(config, n_init=1, mixture_init=1)
    runs = seed_runs(x, names, {"one": (model, k, kind)}, once, config.seed + 1000, n_runs)
    return validity.spread(validity.run_agreement(cut(runs), "id", 1))


def ranked(table: DataFrame) -> DataFrame:
    """Candidates by their summed ranks: indices, agreement over seeds and subsamples, for mixtures BIC and AIC too; small clusters cost three.

    table: candidates' rows, with seed_ari and ari where stability is known. Usable ones have ten rows in each cluster and an agreement of 0.60.
    """
    for c in ("seed_ari", "ari"):
        table = table if c in table.columns else table.withColumn(c, F.lit(None).cast("double"))
    is_gmm = F.col("model") == "gmm"
    scored = rank.composite_rank(table.withColumn("_all", F.lit(1)), ["silhouette", "ch", "seed_ari", "ari"], ["db", "bic", "aic"], ["_all"], {"bic": is_gmm, "aic": is_gmm}, F.when(F.col("min_size") < 10, 3.0).otherwise(0.0), "rank_score").drop("_all")
    return validity.mark_usable(scored).orderBy(*rank.nulls_last("rank_score", "-ari", "-silhouette", "key"))


def run(spark: SparkSession, features: DataFrame, traits: DataFrame, folder: str, config: Config = Config(), created_at: str | None = None, axes: tuple[str, ...] = (), with_stability: bool = True) -> dict[str, DataFrame]:
    """All steps, written as tables under folder/<hash of the configuration>; the manifest and the run tables get rows. traits: id, continuous columns, and 0/1 columns named in axes."""
    names = [c for b in scale.chosen_blocks(config.blocks, config.structure).values() for c in b]
    x = subject_matrix(features, config)
    table, solutions = candidates(x, names, config)
    mark = config_hash(asdict(config))
    runs = None
    if with_stability:
        stats, runs = stability(x, names, {key: (s.model, s.k, s.extra.get("kind")) for key, s in solutions.items()}, config)
        table = table.join(stats, "key")
    order = cut(ranked(table))
    top = order.first()
    best = solutions[top["key"]]
    labels = cut(best.labels)
    labelled = cut(x.join(labels, "id"))
    vectors = cut(validity.as_vector(labelled, "id", names))
    every = None
    for key, s in solutions.items():
        one = s.labels.select(F.lit(key).alias("key"), "id", "cluster")
        every = one if every is None else every.unionByName(one)
    profile = cut(validity.profile(labelled, names))
    degrees = {c: F.col(c).cast("double") for c in ("df1", "df2")}
    first_of = lambda keys: rank.top_per_group(order, keys, rank.nulls_last("rank_score", "key"), 1).drop("place")
    out = {
        "matrix": x, "candidates": order, "labels": every, "model_best": first_of(["model"]), "best_of_k": first_of(["model", "k"]),
        "profile": profile, "interpretation": validity.interpretation(profile), "discriminability": inference.with_tail(validity.discriminability(labelled, names).withColumns(degrees), "f", ["f", "df1", "df2"]),
        "outliers": validity.distance_outliers(vectors, "id"), "tiny": validity.tiny_causes(vectors), "blocks": spark.createDataFrame(linear.block_diagnostics(x, scale.chosen_blocks(config.blocks, config.structure)), BLOCK_ROW),
    }
    c = linear.components(x, names)
    out |= component_frames(spark, c, names)
    out["embedding"] = linear.scores(labelled, names, c["vectors"][:, :2], c["mean"], c["sd"]).select("id", "cluster", *(f"pc{i + 1}" for i in range(min(2, c["vectors"].shape[1]))))
    if config.pair_tables:
        out["distances"] = validity.label_ordered(validity.distances(vectors, "id"), labels, "distance")
        if runs is not None:
            out["coclustering"] = validity.label_ordered(validity.coclustering(runs.where(F.col("key") == top["key"])), labels, "together")
    # Tests of the best usable partition; where none is usable, of the best.
    tested = order.where("usable").first() or top
    merged = traits.join(solutions[tested["key"]].labels, "id")
    own = config.trait_sets or [t for t in traits.columns if t != "id" and t not in axes]
    out |= inference.posthoc(merged, "id", "cluster", own, list(axes), config.n_perm, config.seed, config.alpha)
    write_tables(out, f"{folder}/{mark}")
    append_row(spark, f"{folder}/manifest", {"run": mark, "created_at": created_at or "", "structure": config.structure, "n_features": len(names)}, "run string, created_at string, structure string, n_features int")
    log_run(spark, folder, mark, {"structure": config.structure, "best": top["key"], "tested": tested["key"], "seed": config.seed}, {f"best_{m}": top[m] for m in ("silhouette", "ch", "db", "bic", "aic", "seed_ari", "ari", "rank_score")}, asdict(config), {"features": names, "tables": sorted(out)}, created_at=created_at)
    return out


def component_frames(spark: SparkSession, c: dict, names: list[str]) -> dict[str, DataFrame]:
    """What pictures of components show: scree (component, value, share, cumulative, kept for 80, 90 and 95 %) and loadings (feature, component, loading, rank inside it)."""
    least = {p: linear.enough(c["cumulative"], p / 100) for p in (80, 90, 95)}
    scree = [(i + 1, float(v), float(c["share"][i]), float(c["cumulative"][i]), *(i < least[p] for p in least)) for i, v in enumerate(c["values"])]
    loads = []
    for j in range(c["loadings"].shape[1]):
        order = sorted(range(len(names)), key=lambda i: (-abs(c["loadings"][i, j]), names[i]))
        loads += [(names[i], j + 1, float(c["loadings"][i, j]), place + 1) for place, i in enumerate(order)]
    return {"scree": spark.createDataFrame(scree, "component int, value double, share double, cumulative double, in_80 boolean, in_90 boolean, in_95 boolean"), "loadings": spark.createDataFrame(loads, "feature string, component int, loading double, place int")}


def component_report(frames: dict[str, DataFrame], most: int = 3) -> str:
    """Components in words: value, share and the features that weigh most, down to those needed for 95 %."""
    tops: dict[int, list[str]] = {}
    for r in frames["loadings"].where(F.col("place") <= most).orderBy("component", "place").collect():
        tops.setdefault(r.component, []).append(f"{r.feature} ({r.loading:+.2f})")
    return "\n".join(f"component {r.component}: eigenvalue {r.value:.4f}, {100 * r['share']:.1f} % (together {100 * r.cumulative:.1f} %), {', '.join(tops[r.component])}" for r in frames["scree"].where("in_95").orderBy("component").collect())


def total_report(tables: dict[str, DataFrame]) -> str:
    """Everything in words: all candidates by rank, the best of each model and of each number of clusters, what sets the best one's clusters apart, their members far out and small clusters, components and tests."""
    part = lambda title, lines: [title, "-" * len(title), *(lines or ["none"]), ""]
    collect = lambda name, *by: tables[name].orderBy(*by).collect() if name in tables else []
    best = lambda r: f"{r['key']}: score {r['rank_score']:.1f}, sizes {r['sizes']}"
    out = part("candidates", report(tables["candidates"], 1_000).splitlines())
    out += part("best of each model", [f"{r['model']}: {best(r)}" for r in collect("model_best", "model")])
    out += part("best of each model and number of clusters", [f"{r['model']} k={r['k']}: {best(r)}" for r in collect("best_of_k", "model", "k")])
    out += part("clusters", [f"cluster {r['cluster']}: {r['text']}" for r in collect("interpretation", "cluster")])
    out += part("features by how far they tell clusters apart", [f"{r['feature']}: F {r['f'] or 0:.3f}, eta2 {r['eta2'] or 0:.3f}, p {r['p'] if r['p'] is not None else float('nan'):.4f}" for r in collect("discriminability", F.desc_nulls_last("eta2"), "feature")])
    far = tables["outliers"].where("outlier").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("z")).orderBy("cluster").collect() if "outliers" in tables else []
    out += part("members far from their centre", [f"cluster {r['cluster']}: {r['n']}, up to {r['z']:.2f} deviations" for r in far])
    out += part("small clusters", [f"cluster {r['cluster']} of {r['size']}: {r['cause']} (nearest {r['nearest']}, ratio {r['ratio']:.2f})" for r in collect("tiny", "cluster")])
    if "scree" in tables:
        out += part("components", component_report(tables).splitlines())
    if "global" in tables:
        out += part("tests", posthoc_report(tables).splitlines())
    return "\n".join(out)


BLOCK_ROW = "block string, n_features int, mean_abs_r double, max_abs_r double, pc1 double, pc2 double, mean_norm double, sd_norm double"


def multirun(spark: SparkSession, features: DataFrame, traits: DataFrame, folder: str, structures: list[str], config: Config = Config(), **options) -> dict[str, dict[str, DataFrame]]:
    """run() for each structure."""
    return {s: run(spark, features, traits, folder, replace(config, structure=s), **options) for s in structures}


def posthoc_report(tables: dict[str, DataFrame]) -> str:
    """The tests in words: a line for each global test and for each trait or axis."""
    lines = [f"{r['mode']}: n {r['n']}, statistic {r['statistic'] if r['statistic'] is not None else float('nan'):.6f}, p {r['p'] if r['p'] is not None else float('nan'):.6f}" for r in tables["global"].collect()]
    for name, what, stat in (("tests", "feature", "f"), ("binary_tests", "axis", "chi2")):
        if name in tables:
            lines += [f"- {r['mode'] + ' ' if 'mode' in r else ''}{r[what]}: {stat} {r[stat] or 0:.4f}, p_holm {r['p_holm']:.6f}" for r in tables[name].orderBy("p_holm", what).collect()]
    return "\n".join(lines)


def report(order: DataFrame, most: int = 10) -> str:
    """The best candidates in words, one line each."""
    line = F.format_string("%s: score %.1f, silhouette %.4f, CH %.2f, DB %.4f, sizes %s%s", "key", "rank_score", F.coalesce("silhouette", F.lit(float("nan"))), F.coalesce("ch", F.lit(float("nan"))), F.coalesce("db", F.lit(float("nan"))), "sizes", F.when(F.col("usable"), "").otherwise(" (not usable)"))
    return "\n".join(r[0] for r in order.limit(most).select(line).collect())


def block_report(x: DataFrame, blocks: dict[str, list[str]]) -> list[dict]:
    """Validity of each block for component analysis."""
    return [{"block": b} | linear.validity(x, names) for b, names in blocks.items()]
