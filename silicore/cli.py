"""Command line: ``python -m silicore.cli [--config FILE] [--env NAME] COMMAND ...``."""

from __future__ import annotations

import argparse
import os
import sys

from silicore.operators import analysis
from silicore.operators.retest import verify_flags
from silicore.serving import export
from silicore.session import Session, spark_session
from silicore.sources import config
from silicore.sources.store import Store
from silicore.streaming.ingest import Ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="silicore")
    p.add_argument("--config", "-c")
    p.add_argument("--env", "-e")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "ingest-all", "watch"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--product", "-p")
        s.add_argument("--sub-process", "-s")
        s.add_argument("--force", "-f", action="store_true")
        s.add_argument("--retry-corrupt", action="store_true")
        s.add_argument("--strict", action="store_true")
        s.add_argument("--glob", "-g", default="*")
        _ingest_options(s)
    s = sub.add_parser("fetch")
    s.add_argument("--product", "-p")
    s.add_argument("--number", "-n", type=int)
    s.add_argument("--no-ingest", action="store_true")
    s.add_argument("--retry-corrupt", action="store_true")
    s.add_argument("--test-type", "-t", help="only logs of this category, such as CP or FT")
    s.add_argument("--force", "-f", action="store_true", help="fetch files that the history has, too")
    s.add_argument("--reingest", action="store_true", help="take in downloaded logs that the manifest has, too")
    s.add_argument("--cleanup", action=argparse.BooleanOptionalAction, default=True, help="remove downloads that were taken in")
    _ingest_options(s)
    s = sub.add_parser("serve")
    s.add_argument("--host")
    s.add_argument("--port", type=int)
    db = sub.add_parser("db").add_subparsers(dest="action", required=True)
    db.add_parser("lots")
    s = db.add_parser("query")
    s.add_argument("sql")
    s.add_argument("--limit", "-n", type=int, default=100, help="rows shown; 0 for all")
    db.add_parser("shell")
    s = db.add_parser("verify-flags")
    s.add_argument("--lot", "-l")
    an = sub.add_parser("analyze").add_subparsers(dest="action", required=True)
    for name in ("yield", "test-fail", "bins"):
        s = an.add_parser(name)
        s.add_argument("lot")
        if name == "test-fail":
            s.add_argument("--top", "-n", type=int, default=10)
    ex = sub.add_parser("export").add_subparsers(dest="action", required=True)
    s = ex.add_parser("csv")
    s.add_argument("sql")
    s.add_argument("out")
    s.add_argument("--format", "-f", default="csv", choices=["csv", "parquet", "json"])
    s = ex.add_parser("lot")
    s.add_argument("lots", nargs="+")
    s.add_argument("out")
    s.add_argument("--pivot", action=argparse.BooleanOptionalAction, default=True)
    return p


def _ingest_options(s: argparse.ArgumentParser) -> None:
    s.add_argument("--workers", "-w", type=int, default=1000, help="logs that one batch parses side by side, as far as there are cores")
    s.add_argument("--timeout", type=float, default=300.0, help="seconds for the records of one log; 0 for no limit")
    s.add_argument("--verbose", "-v", action="store_true")


def _ingest(args: argparse.Namespace, store: Store) -> Ingest:
    return Ingest(store, args.product, getattr(args, "sub_process", None), getattr(args, "strict", False), args.timeout or None)


def _show(df, limit: int) -> None:
    """Up to ``limit`` rows as a table, all of them for 0, and a word on whether there are more."""
    rows = (df.limit(limit + 1) if limit else df).collect()
    kept = rows[:limit] if limit else rows
    df.sparkSession.createDataFrame(kept, df.schema).show(max(1, len(kept)), truncate=False)
    print(f"{len(kept)} rows" + (", and more" if len(rows) > len(kept) else ""))


def _shell(s: Session) -> int:
    """SQL from standard input, a statement up to its semicolon; a failure does not end it."""
    text = ""
    for line in sys.stdin:
        text += line
        if line.rstrip().endswith(";"):
            sql, text = text.strip().rstrip(";"), ""
            if sql.lower() in ("exit", "quit"):
                break
            try:
                _show(s.q(sql), 100)
            except Exception as e:  # noqa: BLE001 - the statement's failure is the user's to see
                print(str(e).splitlines()[0], file=sys.stderr)
    return 0


def _fetch(args: argparse.Namespace, settings: config.Settings, store: Store) -> int:
    from silicore.sources.ftp import Fetcher, History, fetch_new, quarantine

    history = History(f"{settings.download_dir}/history.json")
    with Fetcher(settings) as f:
        got = fetch_new(f, history, settings.download_dir, args.retry_corrupt, args.number, args.test_type, args.force)
    print({k: len(v) for k, v in got.items()})
    bad = len(got["corrupt"]) + len(got["failed"])
    if not args.no_ingest:
        done = _ingest(args, store).directory(settings.download_dir, args.reingest, args.retry_corrupt, args.workers).collect()
        state = {os.path.abspath(r.file.removeprefix("file:")): r for r in done}
        bad += sum(r.status != "ok" for r in done)
        for remote, f in history.pending():
            r = state.get(os.path.abspath(f["local_path"]))
            if r is not None and r.status == "ok":
                history.ingested(remote)
                if args.cleanup and os.path.exists(f["local_path"]):
                    os.remove(f["local_path"])
            elif r is not None:
                del history.state["files"][remote]
                history.corrupt(remote, f["product"], f["test_type"], r.error, quarantine(f["local_path"], settings.download_dir))
    return int(bad > 0)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    settings = config.load(args.config).for_env(args.env)
    store = Store(spark or spark_session(), settings.data_dir, settings.gross_die, settings.compression)
    if args.command in ("ingest", "ingest-all"):
        done = _ingest(args, store).directory(args.path, args.force or args.command == "ingest", args.retry_corrupt, args.workers)
        _show(done.select("file", "lot_id", "status", "error"), 0 if args.verbose else 100)
        return int(not done.where("status <> 'ok'").isEmpty())
    if args.command == "watch":
        _ingest(args, store).stream(args.path, f"{settings.data_dir}/_checkpoint", args.glob, args.workers)
        return 0
    if args.command == "fetch":
        return _fetch(args, settings, store)
    if args.command == "serve":
        from silicore.serving.server import Service, serve

        host, port = args.host or settings.host, args.port or settings.port
        service = Service(store.spark, lambda s: Store(s, store.path, store.gross_die).model(), settings.max_rows)
        serve(service, host, port).serve_forever()
        return 0
    with Session(store) as s:
        m = s.model
        if args.command == "db" and args.action == "verify-flags":
            out = verify_flags(m.test_data, args.lot).orderBy("lot_id").collect()
            print(*out, sep="\n")
            return int(any(r.null_flags or r.orphaned_keys or r.inconsistent_runs or r.dup_current for r in out))
        if args.command == "export":
            df = s.q(args.sql) if args.action == "csv" else export.lots(m, args.lots, args.pivot)
            print(export.to_file(df, args.out, getattr(args, "format", "csv")), "rows")
            return 0
        if args.command == "db" and args.action == "shell":
            return _shell(s)
        df = {
            ("db", "lots"): lambda: analysis.lot_summary(m), ("db", "query"): lambda: s.q(args.sql), ("analyze", "yield"): lambda: analysis.wafer_yield(m, args.lot),
            ("analyze", "test-fail"): lambda: analysis.test_fail_rate(m, args.lot, args.top), ("analyze", "bins"): lambda: analysis.bin_summary(m, args.lot),
        }[args.command, args.action]()
        _show(df, getattr(args, "limit", 100))
    return 0


if __name__ == "__main__":
    sys.exit(main())
