"""``python -m merkleframe``: a thin front to imports, roots, collection and the query registry."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("merkleframe")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--rows", type=int, default=20)
    sub.add_parser("queries", help="list the registered queries")
    for name, text in (("import", "import a folder or a tar archive under a root"), ("roots", "list roots"), ("gc", "drop what no root reaches"), ("vacuum", "delete old snapshots")):
        c = sub.add_parser(name, help=text)
        c.add_argument("repository")
        if name == "import":
            c.add_argument("source")
            c.add_argument("root")
    a = p.parse_args(argv)
    from merkleframe.plans import registry
    from merkleframe.session import local_session

    if a.command == "queries":
        print(*sorted(registry.queries()), sep="\n")
        return 0
    spark = local_session()
    if a.command == "query":
        if a.name not in registry.queries():
            print(f"no query is named {a.name}", file=sys.stderr)
            return 2
        registry.queries()[a.name](spark, a.tables).show(a.rows, truncate=False)
        return 0
    from merkleframe.operators.repository import Repository
    from merkleframe.sources.importers import FilesystemImport, TarImport

    repo = Repository(spark, a.repository)
    if a.command == "import":
        importer = TarImport(a.source, a.root) if a.source.endswith((".tar", ".tar.gz", ".tgz")) else FilesystemImport(a.source, a.root)
        f = importer.to_frames(spark)
        s = repo.session()
        s.stage(f.objects())
        for r in f.roots.collect():
            s.set_root(r["name"], r["target"])
        repo.publish(s)
    elif a.command == "roots":
        for r in repo.snapshot().roots.orderBy("name").toLocalIterator():
            print(r["name"], r["target"])
    elif a.command == "gc":
        print(repo.collect()[1])
    else:
        print(repo.vacuum())
    return 0


if __name__ == "__main__":
    sys.exit(main())
