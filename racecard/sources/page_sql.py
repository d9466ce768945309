"""Stored pages for users of SQL: a table function over a page, and a view per extraction.

``SELECT p.key, r.* FROM pages p, LATERAL page_rows(p.kind, p.raw) r`` lists every row of every
table of each page, in the task that holds the page and without a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racecard.sources.pages import (
    CHARSETS, extract_entity_rates, extract_entries, extract_history, extract_results, scan_page,
)

# Workers get this module's functions with the job, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW = ("table_no int, table_class string, row_no int, row_class string, "
       "cells array<struct<th:boolean,text:string,href:string,link:string>>")

#: View suffix of each extraction.
EXTRACTIONS = {"results": extract_results, "entries": extract_entries, "history": extract_history,
               "rates": extract_entity_rates}


@F.udtf(returnType=ROW)
class PageRows:
    """Every row of every table of a page, tables and rows counted from 0.

    A cell tells whether it is a header, its text, and the target and text of its first link.
    A null page and a kind without a known charset have no rows.
    """

    def eval(self, kind: str, raw: bytes) -> Iterator[tuple]:
        if kind not in CHARSETS:
            return
        for table_no, (table_class, rows) in enumerate(scan_page(raw, CHARSETS[kind])):
            for row_no, (row_class, cells) in enumerate(rows):
                yield table_no, table_class, row_no, row_class, cells


def register_pages(spark: SparkSession, pages: DataFrame, name: str = "pages") -> None:
    """Temporary views ``name`` and ``name_results``, ``_entries``, ``_history``, ``_rates``, and ``page_rows``."""
    spark.udtf.register("page_rows", PageRows)
    pages.createOrReplaceTempView(name)
    for suffix, extract in EXTRACTIONS.items():
        extract(pages).createOrReplaceTempView(f"{name}_{suffix}")
