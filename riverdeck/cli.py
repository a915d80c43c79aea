"""Commands: databases, features, heads and bundles, labelling, training records (see ``parser``)."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from . import labeling
from .functions import reasoning
from .operators import features, metrics, promptdb, rewards
from .session import session
from .sources import database, readers, sinks


def _build(spark, args):
    raw = readers.read_splits(spark, args.raw, limit=args.limit)
    tables = promptdb.build(raw)
    promptdb.write(tables, args.db)
    print(sinks.render(sinks.stats(promptdb.load(spark, args.db)), limit=200))


def _stats(spark, args):
    print(sinks.render(sinks.stats(promptdb.load(spark, args.db)), args.format, 200))


def _query(spark, args):
    promptdb.register(spark, promptdb.load(spark, args.db))
    print(sinks.render(spark.sql(args.sql), args.format, args.limit))


def _export(spark, args):
    promptdb.register(spark, promptdb.load(spark, args.db))
    print("\n".join(sinks.export_catalog(spark, args.out)))


def _ddl(spark, args):
    print(promptdb.ddl(promptdb.load(spark, args.db)))


def _featurize(spark, args):
    sinks.features_parquet(features.features(features.samples(readers.read_splits(spark, args.raw, limit=args.limit)), single=True), args.out)


def _train(spark, args):
    from . import ml

    rows = spark.read.parquet(args.features).withColumnRenamed("_label", "label").where("label is not null")
    parts = metrics.stratified_split(rows, "label", ml.KEY, 0.1).drop("place")
    model = ml.train_action(parts.where("part = 'train'"), ml.CLASSIFIERS[args.algo])
    model.write().overwrite().save(args.out)
    print(sinks.render(metrics.summary(ml.probabilities(model, parts.where("part = 'holdout'")))))


def _labelled_rows(spark, args):
    return spark.read.parquet(args.features).withColumnRenamed("_label", "label").where("label is not null")


def _bundle(spark, args):
    from . import ml

    heads = ml.train_heads(_labelled_rows(spark, args), ml.CLASSIFIERS[args.algo])
    ml.save_bundle(heads, args.out, thresholds={"trust": float(args.trust)})


def _predict(spark, args):
    from . import ml

    ml.apply_bundle(ml.load_bundle(args.bundle), spark.read.parquet(args.features)).write.mode("overwrite").parquet(args.out)


def _eval(spark, args):
    from . import ml

    print(sinks.render(ml.evaluate(ml.load_bundle(args.bundle)["models"], _labelled_rows(spark, args)), args.format))


def _tune(spark, args):
    from . import ml

    ranges = ml.RANGES if args.rounds is None else {**ml.RANGES, "rounds": ("int", 1, int(args.rounds))}
    found = ml.tune(_labelled_rows(spark, args), int(args.trials), int(args.folds), ranges=ranges)
    print(sinks.render(spark.createDataFrame(found).orderBy(F.desc("rung"), "log_loss"), args.format))


def _ensemble(spark, args):
    from . import ml

    parts = metrics.stratified_split(_labelled_rows(spark, args), "label", ml.KEY, 0.1).drop("place")
    final, model = ml.stack(parts.where("part = 'train'"), {name: ml.CLASSIFIERS[name] for name in args.bases.split(",")}, int(args.folds))
    print(sinks.render(metrics.summary(ml.apply_stack(final, model, parts.where("part = 'holdout'"))), args.format))


def _load(spark, args):
    counts = database.load(promptdb.load(spark, args.db), args.url, {k: v for k, v in (("user", args.user), ("password", os.environ.get("PGPASSWORD"))) if v})
    print("\n".join(f"{n}: {counts[n]} rows" for n in promptdb.LOAD_ORDER))


def _ingest(spark, args):
    sinks.samples_jsonl(features.samples(readers.read_splits(spark, args.raw, limit=args.limit)), args.out)


def _reason(spark, args):
    rows = readers.read_pairs(spark, args.rows)
    style = reasoning.structured if args.style == "structured" else reasoning.concise
    out = rows.withColumn("reasoning", style(F.col("instruction"), F.col("output"))).withColumn("labeler", F.lit("template")).withColumnRenamed("output", "action")
    if args.done:
        out = rewards.pending(out, spark.read.parquet(args.done))
    out.write.mode("append").parquet(args.out)


def _label(spark, args):
    result = labeling.run(readers.read_pairs(spark, args.rows), lambda df: labeling.template(df, args.style), args.out, resume=not args.overwrite, limit=args.limit)
    print(f"{result.n_input} rows: {result.n_written} written, {result.n_skipped} done before, {result.n_failed} failed")
    if args.records:
        labeling.to_messages(labeling.read(spark, args.out), labeling.SYSTEM[args.style], args.style).write.mode("overwrite").json(args.records)


def _inspect(spark, args):
    print("\n\n".join(labeling.inspect(spark, args.records, args.limit)))


def _prepare(spark, args):
    sinks.sft_jsonl(readers.read_pairs(spark, args.rows), args.out, args.system, not args.all_streets)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="riverdeck")
    sub = top.add_subparsers(required=True)

    def command(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for o in options:
            flag, _, default = o.partition("=")
            if flag.endswith("!"):
                p.add_argument(f"--{flag[:-1]}", action="store_true")
            elif flag == "limit":
                p.add_argument("--limit", type=int, default=int(default) if default else None)
            elif default:
                p.add_argument(f"--{flag}", default=None if default == "-" else default)
            else:
                p.add_argument(f"--{flag}", required=True)
        return p

    command("build", _build, "raw", "db", "limit")
    command("stats", _stats, "db", "format=table")
    command("query", _query, "db", "sql", "format=table", "limit=50")
    command("export-parquet", _export, "db", "out")
    command("ddl", _ddl, "db")
    command("featurize", _featurize, "raw", "out", "limit")
    command("train", _train, "features", "out", "algo=random_forest")
    command("reason", _reason, "rows", "out", "style=concise", "done=-")
    command("load", _load, "db", "url", "user=-")
    command("ingest", _ingest, "raw", "out", "limit")
    command("bundle", _bundle, "features", "out", "algo=random_forest", "trust=0.0")
    command("predict", _predict, "bundle", "features", "out")
    command("eval", _eval, "bundle", "features", "format=table")
    command("tune", _tune, "features", "trials=16", "folds=5", "rounds=-", "format=table")
    command("ensemble", _ensemble, "features", "bases=random_forest,logistic", "folds=5", "format=table")
    command("label", _label, "rows", "out", "style=concise", "records=-", "limit", "overwrite!")
    command("inspect", _inspect, "records", "limit=3")
    command("prepare-sft", _prepare, "rows", "out", "system=You decide.", "all-streets!")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
