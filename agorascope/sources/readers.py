"""Readers for the forum toolkit's file formats; every one returns a typed DataFrame.

Positions of lines matter in several formats: ``lines`` numbers them per file, in parallel. Charsets other than UTF-8
are decoded by Spark where ``spark.sql.legacy.javaCharsets`` allows it (``korean`` sets it for the session).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import split

#: The columns of an article file, in order.
ARTICLE = ["rating", "title", "content", "author_id", "tag", "article_id", "thread_id", "date", "time", "text_type", "tokens"]
SENTENCE_LABEL = ["sentence_id", "article_id", "thread_id", "content", "label", "author"]


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def korean(spark: SparkSession) -> None:
    """Lets CSV and decode() use charsets such as MS949 and EUC-KR."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path: str, names: list[str], encoding: str = "UTF-8", malformed: str = "PERMISSIVE") -> DataFrame:
    """Quoted CSV whose fields may hold line ends, as strings; ``malformed`` is Spark's parse mode."""
    if encoding.upper() not in ("UTF-8", "UTF8"):
        korean(spark)
    return spark.read.schema(strings(names)).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("mode", malformed).csv(path)


def nested_tokens(column: Column) -> Column:
    """Sentences are parted by |, tokens by /."""
    return F.transform(F.split(column, "[|]", -1), lambda s: F.split(s, "/", -1))


def read_articles(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Articles with typed ids and nested tokens; rows that don't parse or whose ids aren't numbers are dropped."""
    raw = read_csv(spark, path, ARTICLE, encoding, "DROPMALFORMED")
    typed = raw.withColumns({c: F.expr(f"try_cast({c} AS bigint)") for c in ("article_id", "thread_id")} | {"text_type": F.expr("try_cast(text_type AS int)"), "tokens": nested_tokens(F.col("tokens"))})
    return typed.where("article_id IS NOT NULL AND thread_id IS NOT NULL AND tokens IS NOT NULL")


def short_records(spark: SparkSession, path: str, least: int = 9) -> DataFrame:
    """Lines with fewer than ``least`` comma-separated fields."""
    return spark.read.text(path).withColumn("n_fields", F.size(F.split("value", ",", -1))).where(F.col("n_fields") < least)


def read_sentence_labels(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Labelled sentences; the label becomes an array, - the empty one."""
    raw = read_csv(spark, path, SENTENCE_LABEL, encoding)
    ids = {c: F.expr(f"try_cast({c} AS bigint)") for c in ("sentence_id", "article_id", "thread_id")}
    return raw.withColumns(ids | {"label": entity_list(F.col("label"))})


def entity_list(column: Column) -> Column:
    return F.when(F.trim(column) == "-", F.array().cast("array<string>")).otherwise(F.transform(F.split(column, ","), lambda x: F.trim(x)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 0, value): numbered per file in the order of the files' bytes."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    first = raw.groupBy("file", F.spark_partition_id().alias("part")).agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("least").rowsBetween(Window.unboundedPreceding, -1))
    starts = first.select("file", F.shiftright("least", 33).alias("part"), "least", F.coalesce(before, F.lit(0)).alias("before"))
    placed = raw.withColumn("part", F.shiftright("at", 33)).join(starts, ["file", "part"])
    return placed.select("file", (F.col("before") + F.col("at") - F.col("least")).alias("line_no"), "value")


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Trimmed non-empty lines of a file in any charset Spark can decode."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        raw = spark.read.text(path)
    else:
        korean(spark)
        whole = spark.read.format("binaryFile").load(path)
        raw = whole.select(F.explode(F.split(F.decode("content", encoding), r"\r?\n")).alias("value"))
    return raw.select(F.trim("value").alias("value")).where(F.length("value") > 0)


def int_list(column: Column) -> Column:
    """Positive whole numbers between blanks; anything else raises."""
    numbers = F.transform(F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return F.when(F.forall(numbers, lambda x: x > 0), numbers).otherwise(F.raise_error(F.concat(F.lit("not a list of positive numbers: "), column)).cast("array<int>"))


def read_docs(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(doc_id, items): each line's distinct item ids in order; ``first`` keeps only so many lines, as the mini build does."""
    found = lines(spark, path).where(F.length(F.trim("value")) > 0)
    if first is not None:
        found = found.where(F.col("line_no") < first)
    return found.select(F.col("line_no").alias("doc_id"), F.array_sort(F.array_distinct(int_list(F.col("value")))).alias("items"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) from text with a header line "n dim"; rows of another length than dim are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).select(parts.alias("p"))
    header = raw.where(F.size("p") == 2).select(F.expr("try_cast(p[1] AS int)").alias("dim")).where("dim IS NOT NULL").agg(F.max("dim").alias("dim"))
    return raw.crossJoin(F.broadcast(header)).where(F.size("p") == F.col("dim") + 1).select(F.get("p", F.lit(0)).alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vector"))


def read_word2vec_binary(spark: SparkSession, path: str, part_bytes: int = 64 << 20, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, vector) from word2vec's binary format, split into ranges of ``part_bytes``; with a vocabulary (word), only
    its words."""
    found = split.load(spark, split.Word2Vec, path, partbytes=part_bytes)
    return found if vocabulary is None else found.join(vocabulary.select("word").distinct(), "word", "left_semi")


def read_vocabulary(spark: SparkSession, path: str, encoding: str = "UTF-8", offset: int = 0) -> DataFrame:
    """(idx, word) from tab-separated lines; ``offset`` is added to the ids, as for cluster ids."""
    if encoding.upper() not in ("UTF-8", "UTF8"):
        korean(spark)
    return spark.read.schema("idx int, word string").option("sep", "\t").option("encoding", encoding).csv(path).withColumn("idx", F.col("idx") + F.lit(offset))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(item, cluster_id) from lines "cluster item item ..."."""
    parts = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int"))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts.alias("p")).select(F.explode(F.slice("p", 2, F.size("p"))).alias("item"), F.get("p", F.lit(0)).alias("cluster_id"))


def read_itemsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.array_sort(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int"))).alias("items")).distinct()


def read_entities(spark: SparkSession, path: str, sep: str = "\t", lower: bool = True, max_form: int | None = None) -> DataFrame:
    """(group_id, pos, form): the forms of a group in order; ``max_form`` keeps the first so many."""
    parts = F.split(F.lower("value") if lower else F.col("value"), sep)
    forms = F.slice("p", 2, max_form if max_form is not None else F.size("p"))
    each = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts.alias("p")).select(F.get("p", F.lit(0)).cast("int").alias("group_id"), F.posexplode(forms).alias("pos", "form"))
    return each.where(F.length(F.trim("form")) > 0)


def read_affinity(spark: SparkSession, path: str, entities: DataFrame) -> DataFrame:
    """(group_id, word, lift) from lines entity, comma-separated words, lift; the last line wins."""
    parts = F.split("value", "\t")
    raw = lines(spark, path).where(F.size(parts) >= 3).select("file", "line_no", F.lower(F.get(parts, F.lit(0))).alias("form"), F.explode(F.split(F.get(parts, F.lit(1)), ",")).alias("word"), F.get(parts, F.lit(2)).cast("double").alias("lift"))
    return raw.join(entities.select("form", "group_id").distinct(), "form").groupBy("group_id", "word").agg(F.max_by("lift", F.struct("file", "line_no")).alias("lift"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Edges from a post to the post it answers; (0, 0) stands for none."""
    return spark.read.schema("thread_id long, article_id long, parent_thread long, parent_article long").csv(path)


def read_cases(spark: SparkSession, path: str, encoding: str = "UTF-8", part_bytes: int = 16 << 20) -> DataFrame:
    """(file, thread_id, entities, target, context) from a folder of files of length-prefixed blocks, about ``part_bytes`` of
    them a task; each file is streamed."""
    return split.load(spark, split.Cases, path, encoding=encoding, partbytes=part_bytes)


def read_maxent(spark: SparkSession, path: str) -> DataFrame:
    """(label, features): each token's last character is its value."""
    values = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: F.right(x, F.lit(1)).cast("int"))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(values.alias("v")).select(F.get("v", F.lit(0)).alias("label"), F.slice("v", 2, F.size("v")).alias("features"))


def read_pairs(spark: SparkSession, path: str, sep: str = "-") -> DataFrame:
    """(target, context) parted at the first ``sep``."""
    parts = F.split("value", F.lit(sep), 2)
    return spark.read.text(path).select(F.trim(F.get(parts, F.lit(0))).alias("target"), F.trim(F.get(parts, F.lit(1))).alias("context"))


def read_agreement(spark: SparkSession, reports: DataFrame, corpus: DataFrame, label: str) -> DataFrame:
    """The reference's one SQL query: contents of the reports with a label; reports (corpus_id, label), corpus (id, content)."""
    return reports.where(F.col("label") == label).join(corpus, F.col("corpus_id") == F.col("id")).select("content")


def read_sqlite(spark: SparkSession, path: str, table: str, names: list[str], part_rows: int = 1_000_000) -> DataFrame:
    """Columns of a table of a SQLite file, as strings, in ranges of ``part_rows`` row numbers; the file must be readable in
    the tasks."""
    return split.load(spark, split.Sqlite, path, strings(names), table=table, partrows=part_rows)


def posts_only(articles: DataFrame) -> DataFrame:
    """Articles whose text type is 0: posts, no replies."""
    return articles.where("text_type = 0")


def between_lines(found: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows of ``lines`` numbered from ``start`` to before ``stop``."""
    return found.where((F.col("line_no") >= start) & (F.lit(stop is None) | (F.col("line_no") < F.lit(stop))))


def read_categories(spark: SparkSession, words: str, synsets: str, translations: str, encoding: str = "EUC-KR") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three files of a word network, as ``frames.categories`` takes them: words (word_id, word), translations
    (synset_id, word_id, name), synsets (synset_id, offset, name, parents). A parent is written offset_rest."""
    own = read_csv(spark, words, ["word_id", "word"], encoding)
    nets = read_csv(spark, synsets, ["synset_id", "offset", "name", "kind", "above"], encoding)
    parents = F.filter(F.transform(F.split(F.coalesce("above", F.lit("")), ","), lambda x: F.trim(F.split(x, "_")[0])), lambda x: x != "")
    found = read_csv(spark, translations, ["id", "synset_id", "a", "word_id", "b", "c", "name"], encoding)
    return own, found.select("synset_id", "word_id", "name"), nets.select("synset_id", F.trim("offset").alias("offset"), "name", parents.alias("parents"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(features, label) from lines of comma-separated numbers, the label last."""
    parts = F.transform(F.split(F.trim("value"), ","), lambda x: x.cast("double"))
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts.alias("p"))
    return raw.select(F.slice("p", F.lit(1), F.size("p") - 1).alias("features"), F.element_at("p", -1).cast("int").alias("label"))


def read_polarity(spark: SparkSession, positive: str, negative: str, encoding: str = "UTF-8") -> DataFrame:
    """(text, label) of two files of sentences: 1 and 0."""
    one, two = (read_lines(spark, p, encoding).select(F.col("value").alias("text"), F.lit(y).alias("label")) for p, y in ((positive, 1), (negative, 0)))
    return one.unionByName(two)


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; if there is none, what ``build`` gives is written there first."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
