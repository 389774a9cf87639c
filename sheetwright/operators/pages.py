"""Page tables, greedy pagination, table ranges of cell-marked paragraphs, redaction, request checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delete_pages(pages: DataFrame, gone: list[int]) -> DataFrame:
    """pages(doc_id, page_no, ...) without some, numbered anew from 1."""
    return renumber(pages.where(~F.col("page_no").isin(gone)), [F.col("page_no")])


def renumber(pages: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order)
    return pages.withColumn("page_no", F.row_number().over(w))


def move_page(pages: DataFrame, page: int, to: int) -> DataFrame:
    """The page lands at place `to`, the others close up."""
    place = F.when(F.col("page_no") == page, F.lit(to + (0.5 if to > page else -0.5))).otherwise(F.col("page_no").cast("double"))
    return renumber(pages.withColumn("_at", place), [F.col("_at")]).drop("_at")


def rotate_pages(pages: DataFrame, which: list[int], degrees: int) -> DataFrame:
    return pages.withColumn("rotation", F.when(F.col("page_no").isin(which), F.pmod(F.col("rotation") + degrees, F.lit(360))).otherwise(F.col("rotation")))


def duplicate_page(pages: DataFrame, page: int) -> DataFrame:
    """A copy right after the page."""
    both = pages.withColumn("_c", F.lit(0)).unionByName(pages.where(F.col("page_no") == page).withColumn("_c", F.lit(1)))
    return renumber(both, [F.col("page_no"), F.col("_c")]).drop("_c")


def merge_documents(pages: DataFrame, docs: list[str], name: str) -> DataFrame:
    """The pages of documents in the order of a list, as one."""
    order = F.array_position(F.array(*map(F.lit, docs)), F.col("doc_id"))
    chosen = pages.where(F.col("doc_id").isin(docs)).withColumn("_o", order).withColumn("_p", F.col("page_no")).withColumn("doc_id", F.lit(name))
    return renumber(chosen, [F.col("_o"), F.col("_p")]).drop("_o", "_p")


def redact(text: Column, patterns: list[str], mark: str = "█") -> Column:
    """Every match of the patterns as blocks of its length."""
    out = text
    for p in patterns:
        hits = F.regexp_extract_all(out, F.lit(f"({p})"), 1)
        rest = F.split(out, p, -1)
        shown = F.transform(hits, lambda h: F.repeat(F.lit(mark), F.char_length(h)))
        out = F.when(F.size(hits) > 0, F.array_join(F.flatten(F.zip_with(rest, shown, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")).otherwise(out)
    return out


def paginate_blocks(blocks: DataFrame, height: float) -> DataFrame:
    """blocks(doc_id, ord, height, keep_next) with `page`: first fit; a block kept with the next one moves on with it.

    A document's blocks stream through one task; its state is a page number, what the page holds and the blocks held back.
    """
    rows = blocks.select("doc_id", "ord", F.col("height").cast("double").alias("height"), "keep_next").repartition("doc_id").sortWithinPartitions("doc_id", "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, page, used, held = None, 1, 0.0, []

        def place(group: list) -> list:
            nonlocal page, used
            need = sum(h for _, h in group)
            if used and used + need > height:
                page, used = page + 1, 0.0
            out = []
            for o, h in group:
                if used and used + h > height:
                    page, used = page + 1, 0.0
                out.append((doc, o, page))
                used += h
            return out

        for pdf in batches:
            done = []
            for d, o, h, keep in pdf.itertuples(index=False):
                if d != doc:
                    done += place(held)
                    doc, page, used, held = d, 1, 0.0, []
                held.append((o, h))
                if not keep:
                    done += place(held)
                    held = []
            yield pd.DataFrame(done, columns=["doc_id", "ord", "page"])
        yield pd.DataFrame(place(held), columns=["doc_id", "ord", "page"])

    return rows.mapInPandas(run, f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, ord {blocks.schema['ord'].dataType.simpleString()}, page int")


def table_ranges(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, first, last, cells): runs of paragraphs(doc_id, ord, text) that hold cell marks (\\x07)."""
    marked = F.col("text").contains("\x07")
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = paragraphs.withColumn("_m", marked).withColumn("_g", F.sum(F.when(F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    cells = F.char_length("text") - F.char_length(F.call_function("replace", F.col("text"), F.lit("\x07"), F.lit("")))
    return rows.where("_m").groupBy("doc_id", "_g").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.sum(cells).cast("long").alias("cells")).drop("_g")


def safe_filename(name: Column) -> Column:
    """The last path part, with _ for control characters and signs that file systems read; `document` if nothing or only dots are left."""
    base = F.regexp_extract(F.trim(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), r"([^/\\]*)$", 1)
    clean = F.regexp_replace(base, r"[\x00-\x1f\x7f-\x9f<>:\"|?*]", "_")
    return F.when(clean.rlike(r"^\.*$"), "document").otherwise(clean)


#: Private, loopback, link-local, broadcast and unspecified IPv4 addresses; those that are also multicast or for documentation.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_INSIDE4 = rf"(?:(?:127|10)(?:\.{_OCTET}){{3}}|172\.(?:1[6-9]|2\d|3[01])(?:\.{_OCTET}){{2}}|(?:192\.168|169\.254)(?:\.{_OCTET}){{2}}|255\.255\.255\.255|0\.0\.0\.0)"
_OTHER4 = rf"(?:(?:22[4-9]|23\d)(?:\.{_OCTET}){{3}}|(?:192\.0\.2|198\.51\.100|203\.0\.113)\.{_OCTET})"


def is_private_host(address: Column) -> Column:
    """Addresses and names that must not be called from outside: an IP address, a host or a URL.

    IPv4: loopback, private, link-local, broadcast, unspecified, multicast and documentation ranges; IPv6: loopback,
    unspecified, multicast, link-local, unique local and mapped IPv4; names: localhost, *.local, *.internal.  Names aren't resolved.
    """
    whole = F.lower(address)
    host = F.regexp_replace(F.regexp_replace(whole, r"^.*?://", ""), r"[/:].*$", "")
    four = f"^(?:{_INSIDE4}|{_OTHER4})$"
    zeros, short = r"(?:0{1,4}:)", r"(?:0{1,4}(?::0{1,4})*)?::(?:0{1,4}:)*"
    six = rf"^(?:{zeros}{{7}}0{{0,3}}[01]|{short}0{{0,3}}[01]?|ff[0-9a-f]{{2}}:[0-9a-f:.]*|fe[89ab][0-9a-f]:[0-9a-f:.]*|f[cd][0-9a-f]{{2}}:[0-9a-f:.]*|(?:{zeros}{{5}}|{short})ffff:{_INSIDE4})$"
    return whole.rlike(six) | host.rlike(four) | host.rlike(r"^localhost$|\.local$|\.internal$")
