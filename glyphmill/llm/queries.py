"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.lineage import cut
from glyphmill.llm import byte_bpe, lookalikes, mojibake, packing, scanned_pages, term_counts
from glyphmill.operators import nested
from glyphmill.plans import records
from glyphmill.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scanned_pages.find_noise(*[table(spark, folder, n) for n in ("text_lines", "scan_pages", "books", "lexicon")])


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The running text of each volume as repaired paragraphs."""
    return scanned_pages.paragraphs(*[table(spark, folder, n) for n in ("text_lines", "scan_pages", "books", "lexicon")])


def p1_words(spark: SparkSession, folder: str) -> DataFrame:
    """Misread words of running text, and what they were."""
    return scanned_pages.repaired_words(*[table(spark, folder, n) for n in ("words", "text_lines", "scan_pages", "books", "lexicon")])


def _item_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The items of valid results as lines, and the pages they stand on; each answer is a page of its own."""
    pages = table(spark, folder, "scan_pages").select("page_id", "book_id", "volume_no", "page_seq", "img_w", "img_h").dropDuplicates(["page_id"])
    answers = table(spark, folder, "responses").select("response_id", "page_id").dropDuplicates(["response_id"]).join(pages, "page_id", "left")
    items = nested.explode_levels(nested.to_variant(records.result_records(spark, folder), "json"), "value", [("ret",)], ["ret_no"])
    rect = F.split(F.try_variant_get("node", "$.rect", "string"), " ")

    def side(name: str, at: int) -> Column:
        return F.coalesce(F.try_variant_get("node", f"$.rect.{name}", "int"), F.try_element_at(rect, F.lit(at)).try_cast("int"))

    lines = items.join(answers.drop("page_id"), "response_id", "left").select(
        F.col("record").alias("page_id"), "book_id", F.col("ret_no").cast("int").alias("line_id"),
        side("left", 1).alias("box_left"), side("top", 2).alias("box_top"), side("width", 3).alias("wid"), side("height", 4).alias("hei"),
        "img_w", "img_h", F.try_variant_get("node", "$.word", "string").alias("line_str"),
    )
    return lines, answers.select(F.col("response_id").cast("string").alias("page_id"), "book_id", "volume_no", "page_seq").filter("page_id IS NOT NULL")


def p1_item_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The running text of the items of results as repaired paragraphs; ``page_id`` is the key of the answer."""
    lines, pages = _item_lines(spark, folder)
    return scanned_pages.paragraphs(lines, pages, table(spark, folder, "books"), table(spark, folder, "lexicon"))


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    tables = [table(spark, folder, n) for n in ("words", "books", "lexicon")]
    return lookalikes.changed_words(*tables)


def p2_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words that are not in their consistent form, and that form."""
    return _changed(spark, folder).select("page_id", "line_id", "word_id", "word_str", "form")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    changed = cut(_changed(spark, folder))
    words = changed.select("page_id", "line_id", "word_id", F.lit(-1).alias("char_id"))
    return words.unionByName(lookalikes.changed_chars(changed, table(spark, folder, "chars")))


def _term_tables(spark: SparkSession, folder: str) -> DataFrame:
    chars = term_counts.term_counts(table(spark, folder, "chars"), "page_id", "char_str", ["line_id", "word_id", "char_id"])
    letters = term_counts.term_counts(table(spark, folder, "letters"), "sample_id", "letter", ["letter_no"])
    both = chars.withColumn("src", F.lit("chars")).unionByName(letters.withColumn("src", F.lit("letters")))
    return term_counts.mark_terms(both)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences, its records and its mark."""
    return _term_tables(spark, folder).select("src", "term", "occurrences", "records", "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _term_tables(spark, folder).filter("mark IS NOT NULL").select("src", "term", "mark")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_texts(table(spark, folder, "documents").select("doc_id", "text"))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


def p7_pack_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of p7_pack, in one row: all texts are placed whole, no container is overfull, no pieces overlap, no text is divided that fits."""
    placed = cut(p7_pack(spark, folder))
    boxes = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"), F.max(F.col("at") + F.col("n_tokens")).alias("top"))
    texts = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("reach"))
    bad = boxes.agg(F.count_if(F.col("fill") > packing.CAPACITY).alias("overfull"), F.count_if(F.col("fill") != F.col("top")).alias("overlapping"))
    divided = (F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)
    return texts.agg(F.count("*").alias("texts"), F.count_if(divided).alias("divided_early"), F.count_if(F.col("n") != F.col("reach")).alias("incomplete")).crossJoin(bad)


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The affected documents, repaired where they can be, and what was undone."""
    docs = mojibake.find_damage(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.filter("affected").select("doc_id", "restored", "steps")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.find_damage(table(spark, folder, "documents").select("doc_id", "text")).filter("affected").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p1_words": p1_words,
    "p1_item_paragraphs": p1_item_paragraphs,
    "p2_found": p2_found,
    "p2_words": p2_words,
    "p3_counts": p3_counts,
    "p3_found": p3_found,
    "p6_ids": p6_ids,
    "p7_pack": p7_pack,
    "p7_pack_check": p7_pack_check,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}
