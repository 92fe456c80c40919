"""Tables of the engine: catalog scans, dictionaries, spreadsheets."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerweave.functions.dates import rfc3339


def catalog_scan(products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Products with their vendor's name: blank text and zero for nulls, times as text. Only the
    columns that a plan uses are read. The optimiser broadcasts vendors if they are small."""
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    joined = products.drop("vendor_name").join(v, "vendor_id")
    text = [c for c, k in joined.dtypes if k == "string"]
    numbers = [c for c, k in joined.dtypes if k == "double"]
    out = joined.withColumns({**{c: F.coalesce(c, F.lit("")) for c in text}, **{c: F.coalesce(c, F.lit(0.0)) for c in numbers}})
    return out.withColumn("updated_at", rfc3339(F.col("updated_at"))) if "updated_at" in out.columns else out


def alias_table(entries: DataFrame) -> DataFrame:
    """(alias, canonical, category) of ingredient entries (canonical, category, aliases, ordinal): the
    first entry that names an alias keeps it."""
    from offerweave.functions.text import normalize_key

    long = entries.select("canonical", "category", "ordinal", F.posexplode("aliases").alias("_i", "_a")).withColumn("alias", normalize_key(F.col("_a"))).filter("alias <> ''")
    one = long.groupBy("alias").agg(F.min(F.struct("ordinal", "_i", "canonical", "category")).alias("e"))
    return one.select("alias", "e.canonical", "e.category")


def _sheet_rows(blob: bytes):
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag.endswith("}si"):
                    shared.append("".join(t.text or "" for t in e.iter(f"{{{ns['m']}}}t")))
        first = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for _, row in ElementTree.iterparse(z.open(first)):
            if not row.tag.endswith("}row"):
                continue
            cells = {}
            for i, c in enumerate(row.findall("m:c", ns)):
                letters = re.sub(r"\d", "", c.get("r") or "")
                at = i
                if letters:
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = c.find("m:v", ns)
                kind = c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text
            yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            row.clear()


def read_xlsx(spark: SparkSession, path: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Rows of the first sheet of each workbook as text; headers are matched case aside. A workbook
    without a required header is an error. Each file is one task's work."""
    columns = [*required, *optional]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column("content").to_pylist():
                rows = _sheet_rows(blob)
                header = [h.strip().lower() for h in next(rows, [])]
                if missing := [c for c in required if c.lower() not in header]:
                    raise ValueError(f"missing headers: {missing}")
                at = [header.index(c.lower()) if c.lower() in header else -1 for c in columns]
                out = [[(r[i] if 0 <= i < len(r) else "") or None for i in at] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.string()) for j in range(len(columns))], names=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))
