"""Command line: ``python -m tidepanel.cli features|split|scale|run ...``."""

from __future__ import annotations

import argparse
import datetime as dt

from tidepanel.plans import features, workflow
from tidepanel.session import session
from tidepanel.sources import readers, writers


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidepanel")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("features", help="wide table to feature panel")
    f.add_argument("--compat", action="store_true")
    b = sub.add_parser("long-features", help="long stock and macro tables to feature panel")
    w = sub.add_parser("combine", help="long stock and macro tables to one wide table")
    for x in (b, w):
        x.add_argument("--stocks", required=True)
        x.add_argument("--macro", required=True)
        x.add_argument("--output", required=True)
    b.add_argument("--benchmark", default=None)
    s, c, r = sub.add_parser("split"), sub.add_parser("scale"), sub.add_parser("run")
    for x in (f, s, c, r):
        x.add_argument("--input", required=True)
        x.add_argument("--output", required=True)
    for x in (s, r):
        x.add_argument("--start", default="2021-01-01", type=dt.date.fromisoformat)
        x.add_argument("--train-years", default=3, type=int)
        x.add_argument("--test-months", default=1, type=int)
        x.add_argument("--embargo-days", default=5, type=int)
        x.add_argument("--mode", default="rolling", choices=["rolling", "expanding"])
        x.add_argument("--min-train-days-per-ticker", default=250, type=int)
        x.add_argument("--strict-coldstart", action="store_true")
    for x in (s, c, r):
        x.add_argument("--date-col", default="Date")
        x.add_argument("--ticker-col", default=None)
        x.add_argument("--price-col", default="Price")
    c.add_argument("--membership", default=None, help="what split wrote; else the input has split_id and part")
    for x in (c, r):
        x.add_argument("--target", default="Excess_5d_fwd")
        x.add_argument("--include-cols", default="", type=names)
        x.add_argument("--exclude-cols", default="", type=names)
        x.add_argument("--auto-log1p", action="store_true")
        x.add_argument("--log1p-cols", default="", type=names)
        x.add_argument("--impute-na", default=None, type=float)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    given = lambda kind: kind(**{k: v for k, v in vars(a).items() if k in kind.__dataclass_fields__})
    if a.command == "features":
        features.feature_set_a(readers.read_auto(spark, a.input), a.compat).write.mode("overwrite").parquet(a.output)
    elif a.command == "long-features":
        bench = readers.read_auto(spark, a.benchmark) if a.benchmark else None
        features.feature_set_b(readers.read_long(spark, a.stocks), readers.read_long(spark, a.macro), bench).write.mode("overwrite").parquet(a.output)
    elif a.command == "combine":
        writers.write_csv(features.combined_wide(readers.read_long(spark, a.stocks), readers.read_long(spark, a.macro)), a.output)
    elif a.command == "split":
        members, _ = workflow.split_panel(spark.read.parquet(a.input), given(workflow.SplitOptions))
        writers.write_membership(members, a.output)
    elif a.command == "scale":
        panel, o = spark.read.parquet(a.input), given(workflow.ScaleOptions)
        if a.membership:
            panel = workflow.keyed(panel, o.date_col, o.ticker_col)
            o.date_col, o.ticker_col = "Date", "Ticker"
            members = panel.join(writers.read_membership(spark, a.membership).distinct(), ["Date", "Ticker"])
            writers.write_scaled(*workflow.scale_panel(members, o, panel), a.output)
        else:
            writers.write_scaled(*workflow.scale_panel(panel, o), a.output)
    else:
        workflow.run(spark, a.input, a.output, given(workflow.SplitOptions), given(workflow.ScaleOptions))


if __name__ == "__main__":
    main()
