"""Command line: legend, digests, verb queries, tools, policies and questions over a derived grid or raster files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from . import catalog
from .functions import taxonomy as tx
from .plans import audit, triage, verbs
from .plans.index import Index, index
from .session import local_session
from .sources import notes
from .sources.store import IndexStore


def tsv(df: DataFrame, limit: int = 40) -> str:
    """Rows as tab-separated text; a cut is always said."""
    total = df.count()
    lines = ["\t".join(df.columns)] + ["\t".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.limit(limit).collect()]
    return "\n".join(lines + ([f"# NOTE: {total - limit} rows omitted"] if total > limit else []))


def html(title: str, parts: dict[str, str]) -> str:
    """A page of tables from TSV texts."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def table(text: str) -> str:
        out = []
        for k, line in enumerate(text.splitlines()):
            cell = "th" if k == 0 else "td"
            out.append(f"<p>{esc(line)}</p>" if line.startswith("#") else "<tr>" + "".join(f"<{cell}>{esc(v)}</{cell}>" for v in line.split("\t")) + "</tr>")
        return "<table>" + "".join(x for x in out if x.startswith("<tr")) + "</table>" + "".join(x for x in out if x.startswith("<p"))

    return f"<!doctype html><meta charset=utf-8><title>{esc(title)}</title><h1>{esc(title)}</h1>" + "".join(f"<h2>{esc(k)}</h2>{table(v)}" for k, v in parts.items())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="geoloom", description=__doc__)
    p.add_argument("--sf-dir", default="/root/testdata/sf0.001")
    p.add_argument("--input", help="a label raster, or a directory of tiles, instead of the derived grid")
    p.add_argument("--gsd", type=float, default=0.5, help="metres a cell of --input")
    p.add_argument("--mapping", help="JSON of wire id to class name for --input")
    p.add_argument("--cache", help="a folder that keeps index tables across sessions")
    p.add_argument("--limit", type=int, default=40)
    sub = p.add_subparsers(dest="verb", required=True)
    for name in ("legend", "queries", "audit", "notes-template", "tools"):
        sub.add_parser(name)
    sub.add_parser("run").add_argument("query")
    sub.add_parser("ask").add_argument("text", nargs="+")
    sub.add_parser("triage").add_argument("text", nargs="+")
    t = sub.add_parser("tool")
    t.add_argument("name")
    t.add_argument("args", nargs="?", default="{}")
    sub.add_parser("report").add_argument("path")
    a = p.parse_args(argv)
    if a.verb == "legend":
        print("\n".join(f"{r[0]}\t{r[2]}\t{r[3]}" for r in tx.rows()))
    elif a.verb == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
    elif a.verb == "notes-template":
        print(notes.template())
    elif a.verb == "tools":
        print(json.dumps(verbs.tool_definitions(), indent=1))
    else:
        spark = local_session()
        try:
            kept = IndexStore(spark, a.cache) if a.cache else None
            i = Index.from_raster(spark, a.input, a.gsd, a.mapping, kept) if a.input else index(spark, a.sf_dir)
            if a.input and a.verb in ("run", "report"):
                raise ValueError(f"{a.verb} works on the tables of --sf-dir; a raster takes ask, triage, tool and audit")
            if a.verb == "run":
                print(tsv(catalog.QUERIES[a.query](spark, a.sf_dir), a.limit))
            elif a.verb == "ask":
                print(tsv(verbs.run(i, " ".join(a.text)).rows, a.limit))
            elif a.verb == "triage":
                policy = triage.compile_query(" ".join(a.text))
                key = ["chip_r", "chip_c"]
                print("# " + policy.understood())
                print(tsv(triage.select(triage.score(policy, i.chip_frac, triage.units(i), key), key).where("selected").orderBy("rank"), a.limit))
            elif a.verb == "tool":
                print(json.dumps(verbs.call(i, a.name, json.loads(a.args)), default=str))
            elif a.verb == "audit":
                print(tsv(audit.Audit(i).worklist(a.limit), a.limit))
            elif a.verb == "report":
                names = ["l0_histogram", "describe", "cause_rollup", "coverage", "s3_selected", "tile_diff"]
                with open(a.path, "w", encoding="utf-8") as f:
                    f.write(html("Map report", {n: tsv(catalog.QUERIES[n](spark, a.sf_dir), a.limit) for n in names}))
        except (ValueError, KeyError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
