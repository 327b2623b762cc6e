"""``python -m glosswright FOLDER ...``: looks at and rewrites a reference manager's tables, kept as Parquet.

An action runs only if its option and all that it needs are given.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from glosswright.operators import store
from glosswright.plans import composites
from glosswright.session import local_session
from glosswright.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glosswright")
    p.add_argument("folder", help="holds groups, remote, links, marks, rects, files and glyphs as Parquet tables")
    p.add_argument("--list-groups", action="store_true")
    p.add_argument("--list-documents", action="store_true", help="of the group")
    p.add_argument("--annotate", action="store_true", help="marks the pattern in the document")
    p.add_argument("--remove-annotation", action="store_true", help="takes automatic marks away")
    p.add_argument("--html", metavar="OUT", help="writes the marked pages of the group's documents")
    p.add_argument("-g", "--group")
    p.add_argument("-d", "--document")
    p.add_argument("--pattern")
    return p


def actions(spark: SparkSession, given: argparse.Namespace) -> dict[str, DataFrame]:
    """What each action asked for shows or would write, by name; nothing for actions that lack an argument."""
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{given.folder}/{name}")

    out: dict[str, DataFrame] = {}
    if given.list_groups:
        out["groups"] = table("groups").where("name <> ''").select("name").distinct().orderBy("name")
    if given.list_documents and given.group:
        out["documents"] = store.group_documents(table("remote"), table("groups"), given.group).select("document_id").distinct().orderBy("document_id")
    if given.annotate and given.document and given.pattern:
        wanted = spark.createDataFrame([(1, given.pattern)], "item_id long, text string")
        glyphs = table("glyphs")
        out["new_marks"], out["new_rects"] = composites.annotate(glyphs.where(glyphs["doc"] == given.document), wanted)
    if given.remove_annotation:
        out["kept_marks"], out["kept_rects"] = store.without_automatic(table("marks"), table("rects"))
    if given.html and given.group:
        own = store.group_documents(table("remote"), table("groups"), given.group).selectExpr("cast(document_id AS string) AS doc").distinct()
        marks = table("page_marks")
        pages = composites.marked_pages(table("glyphs").join(own, "doc", "left_semi"), marks)
        out["html"] = composites.document_pages(pages)
    return out


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    spark = local_session()
    for name, rows in actions(spark, given).items():
        if name == "html":
            io.write_pages(rows, given.html, "doc")
        elif name.startswith(("new_", "kept_")):
            rows.write.mode("overwrite").parquet(f"{given.folder}/{name}")
        else:
            rows.show(1000, truncate=False)


if __name__ == "__main__":
    main()
