"""Command line: split, sweep, load-npy, move, kick, clean."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timbrel.operators import slices, spectral
from timbrel.plans import clustering
from timbrel.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="timbrel")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("split", help="cluster a folder of recordings")
    p.add_argument("--spk", required=True)
    p.add_argument("--nmin", type=int, default=1)
    p.add_argument("--cluster", type=int, choices=(1, 2), default=1, help="1 spectral, 2 density")
    p.add_argument("--encoder", choices=slices.ENCODERS, default="timbre")
    p.add_argument("--mer_cosine", type=float)
    p.add_argument("--root", default=".")
    p.add_argument("--ask", action="store_true", help="ask for another nmin until the clusters will do")
    p = sub.add_parser("sweep", help="the number of clusters that each nmin gives")
    p.add_argument("--spk", required=True)
    p.add_argument("--encoder", choices=slices.ENCODERS, default="timbre")
    p.add_argument("--root", default=".")
    p = sub.add_parser("load-npy", help="project a matrix")
    p.add_argument("--path", required=True)
    p.add_argument("--reducer", type=int, choices=(1, 2), default=1, help="1 t-SNE, 2 neighbour embedding")
    p.add_argument("--json")
    p.add_argument("--out")
    for name in ("move", "kick"):
        p = sub.add_parser(name)
        p.add_argument("--csv", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--do", action="store_true", help="carry the plan out")
        if name == "kick":
            p.add_argument("--clust", type=int, required=True)
    p = sub.add_parser("clean", help="drop transcript rows without a recording")
    p.add_argument("--csv", required=True)
    p.add_argument("--wavs", required=True)
    return top


def answered(say: Callable[[str], str] = input) -> int | None:
    """The next nmin, None where the clusters will do; what is no number in range is asked for again."""
    if say("Will these clusters do? (y/n) ").strip().lower() in ("y", "yes", ""):
        return None
    while True:
        told = say(f"New nmin ({spectral.MIN_SPEAKERS} to {spectral.MAX_SPEAKERS}): ").strip()
        if told.isdecimal() and spectral.MIN_SPEAKERS <= int(told) <= spectral.MAX_SPEAKERS:
            return int(told)


def split(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    options = {"nmin": a.nmin} if a.cluster == 1 else {}
    return clustering.split(spark, f"{a.root}/input/{a.spk}/raw/wavs", f"{a.root}/output/{a.spk}/clustered_files({a.encoder}).csv", a.encoder, clustering.METHODS[a.cluster - 1], ("tsne", "umap")[a.cluster - 1], a.spk, f"{a.root}/input/{a.spk}/features", merge_cosine=a.mer_cosine, plot=f"{a.root}/output/{a.spk}/clustered_files({a.encoder}).png", **options)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("timbrel").getOrCreate()
    if a.command == "split":
        if a.ask and a.cluster == 1:  # features are cached, so another turn only clusters again
            while True:
                split(spark, a).show(20, truncate=False)
                if (nmin := answered()) is None:
                    return
                a.nmin = nmin
        done = split(spark, a)
    elif a.command == "sweep":
        done = clustering.sweep(spark, f"{a.root}/input/{a.spk}/raw/wavs", a.encoder, a.spk, f"{a.root}/input/{a.spk}/features").orderBy("nmin")
    elif a.command == "load-npy":
        done = clustering.load_matrix(spark, a.path, a.json, ("tsne", "umap")[a.reducer - 1], a.out)
    elif a.command == "clean":
        done = clustering.clean_csv(spark, a.csv, a.wavs)
    else:
        rows = readers.assignments(spark, a.csv)
        plan = writers.route_plan(rows, a.out) if a.command == "move" else writers.kick_plan(rows, a.clust, a.out)
        done = writers.execute(plan, move=a.command == "kick", dry_run=not a.do)
    done.show(20, truncate=False)


if __name__ == "__main__":
    main()
