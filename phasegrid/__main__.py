"""Entry points: python -m phasegrid build|cluster|posthoc|run|levels [--config FILE] [--tables FOLDER] [--out FOLDER] [name=value ...].

Tables are Parquet under --tables: minute, survey, load, traits (build, run), features (cluster, without build) and people (posthoc, run).
levels reads signals, scenes and survey and clusters persons and scenes: --studies person/F0,scenario_all/all (all of them if not given).
Overrides name fields of the configuration, such as structure=PHY or ks=[2,3]; structure=A,B runs once for each.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from .plans import levels, study
from .session import local
from .sources.recordings import latest_run, read_config, write_tables


def config_of(values: dict) -> study.Config:
    known = {f.name for f in fields(study.Config)}
    if unknown := set(values) - known:
        raise KeyError(f"unknown settings {sorted(unknown)}")
    return study.Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="phasegrid", description=__doc__.splitlines()[0])
    p.add_argument("step", choices=["build", "cluster", "posthoc", "run", "levels"])
    p.add_argument("--config")
    p.add_argument("--tables", default="tables")
    p.add_argument("--out", default="out")
    p.add_argument("--axes", default="", help="0/1 columns of people, by comma")
    p.add_argument("--studies", default=",".join(f"person/F{i}" for i in range(6)) + "," + ",".join(f"{x}/all" for x in levels.LEVELS[1:]))
    p.add_argument("--no-stability", action="store_true")
    p.add_argument("overrides", nargs="*")
    a = p.parse_intermixed_args(argv)
    spark = spark or local()
    values = read_config(a.config, a.overrides)
    if a.step == "levels":
        studies = [tuple(x.split("/")) for x in a.studies.split(",") if x]
        grid = levels.Grid(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
        rows = levels.study_rows(*(spark.read.parquet(f"{a.tables}/{n}") for n in ("signals", "survey", "scenes")), studies)
        got = levels.run_levels(rows, studies, grid)
        write_tables(got, f"{a.out}/levels")
        for r in spark.read.parquet(f"{a.out}/levels/metrics").orderBy("level", "set").collect():
            print(f"{r.level} {r.set}: k={r.k} {r.kind} bic={r.bic:.1f} silhouette={r.silhouette:.3f} sizes {r.sizes}")
        return 0
    structures = [x for x in str(values.get("structure", "full")).split(",") if x]
    read = lambda name: spark.read.parquet(f"{a.tables}/{name}")
    axes = tuple(x for x in a.axes.split(",") if x)
    if a.step in ("build", "run"):
        write_tables({"features": study.long_features(*(read(n) for n in ("minute", "survey", "load", "traits")))}, a.out)
    if a.step in ("cluster", "run"):
        features = spark.read.parquet(f"{a.out}/features") if a.step == "run" else read("features")
        people = read("people")
        for structure in structures:
            got = study.run(spark, features, people, a.out, config_of(values | {"structure": structure}), axes=axes, with_stability=not a.no_stability)
            print(study.report(got["candidates"]))
            print(study.posthoc_report(got))
            spark.createDataFrame([(study.total_report(got),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/{study.config_hash(study.asdict(config_of(values | {'structure': structure})))}/report")
    if a.step == "posthoc":
        run = latest_run(spark, a.out)
        config, people = config_of(values), read("people")
        order = spark.read.parquet(f"{a.out}/{run}/candidates")
        best = (order.where("usable").orderBy("rank_score", "key").first() or order.orderBy("rank_score", "key").first())["key"]
        labels = spark.read.parquet(f"{a.out}/{run}/labels").where(f"key = '{best}'").drop("key")
        traits = [c for c in people.columns if c != "id" and c not in axes]
        got = study.inference.posthoc(people.join(labels, "id"), "id", "cluster", traits, list(axes), config.n_perm, config.seed, config.alpha)
        write_tables(got, f"{a.out}/{run}/posthoc")
        print(study.posthoc_report(got))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
