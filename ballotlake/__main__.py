"""python -m ballotlake COMMAND [options], with --data FOLDER.

Commands of :mod:`ballotlake.plans.commands`, and: list, run NAME, publish TARGET, rapport [--semaine], fetch, portraits, build, update.
"""

from __future__ import annotations

import argparse
import sys

from .session import command_session


def parser() -> argparse.ArgumentParser:
    from .plans import commands

    p = argparse.ArgumentParser(prog="ballotlake")
    p.add_argument("--data", default=".", help="folder of the tables")
    p.add_argument("--master", help="Spark master; by default the one the session is started with, or this machine")
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    p.add_argument("--out", help="write the result there as Parquet instead")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in commands.COMMANDS.items():
        c = sub.add_parser(name, help=(f.__doc__ or "").strip().split("\n")[0])
        for option, o in commands.options(name).items():
            if o.default is o.empty:
                c.add_argument(option)
            elif o.default is False:
                c.add_argument(f"--{option.replace('_', '-')}", dest=option, action="store_true")
            else:
                c.add_argument(f"--{option.replace('_', '-')}", dest=option, default=o.default, type=type(o.default) if o.default is not None else str)
    sub.add_parser("list", help="names of the queries")
    sub.add_parser("run", help="one query").add_argument("name")
    c = sub.add_parser("publish", help="serving marts, behind the invariants")
    c.add_argument("target")
    c.add_argument("--allow", nargs="*", default=[], help="invariants that may be broken")
    c = sub.add_parser("rapport", help="a week's alerts as Markdown")
    c.add_argument("--semaine")
    c.add_argument("--sortie")
    for name in ("fetch", "update"):
        c = sub.add_parser(name, help="download the datasets" + (", then build the tables if one is new" if name == "update" else ""))
        c.add_argument("base", help="address of the datasets")
        c.add_argument("--raw", default="raw")
        c.add_argument("--force", action="store_true")
        c.add_argument("--legislature", default="17")
    c = sub.add_parser("portraits", help="download the members' pictures")
    c.add_argument("address", help="address of a picture, with {uid}")
    c.add_argument("--raw", default="raw")
    c = sub.add_parser("build", help="all tables from raw files")
    c.add_argument("raw")
    c.add_argument("--legislature")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from .plans import commands, marts, rollcall, views
    from .plans.assembly import Assembly
    from .sources import catalog

    if a.command == "list":
        print("\n".join(sorted(marts.known_queries())))
        return 0
    if a.command in ("fetch", "update"):
        got = catalog.Downloader(a.raw).fetch_all(catalog.datasets(a.base, a.legislature), force=a.force)
        print("\n".join(f"{k}: {'new' if v else 'unchanged'}" for k, v in got.items()))
        if a.command == "fetch" or not any(got.values()):
            return 0
    spark = command_session(a.master)
    if a.command in ("build", "update"):
        commands.build(spark, a.raw, a.data, a.legislature)
        return 0
    assembly = Assembly(spark, a.data)
    if a.command == "portraits":
        uids = [r[0] for r in assembly.members.select("acteur_uid").toLocalIterator()]
        print(catalog.Downloader(a.raw).fetch_images(uids, a.address))
        return 0
    if a.command == "publish":
        print("\n".join(marts.publish(spark, a.data, a.target, allowed=tuple(a.allow))))
        return 0
    if a.command == "rapport":
        from .operators.alerts import bulletin

        text = bulletin(rollcall.alertes(assembly), a.semaine or str(views.derniere_semaine(assembly).first()[0]))
        print(text) if not a.sortie else open(a.sortie, "w").write(text)
        return 0
    if a.command == "run":
        df = marts.known_queries()[a.name](spark, a.data)
    else:
        df = commands.COMMANDS[a.command](assembly, **{k: getattr(a, k) for k in commands.options(a.command)})
    df.write.mode("overwrite").parquet(a.out) if a.out else df.show(a.rows, truncate=60)
    return int(a.command == "verifier" and not df.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
