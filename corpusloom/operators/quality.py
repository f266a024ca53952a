"""Filters, duplicates, quotas and chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.tables import cut, join_counted, small


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): each document with text and the least id of those equal but for case and white space. Blank texts are equal to each other."""
    norm = F.md5(F.lower(F.array_join(t.pieces(F.col("text")), " ")))
    keyed = cut(docs.where("text IS NOT NULL").select("doc_id", norm.alias("h")))  # hashes only: the texts are read once
    least = cut(keyed.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("k")))  # combined in the tasks: a hot text sends one row each
    hot = small(least.where(F.col("k") > COPIES).select("h", "keep_id"))  # a row for COPIES documents
    cold = keyed.join(hot, "h", "left_anti").join(least.where(F.col("k") <= COPIES), "h")
    return cold.select("doc_id", "keep_id").unionByName(keyed.join(hot, "h").select("doc_id", "keep_id"))


#: Documents of one text after which it is joined apart from the others.
COPIES = 10_000


def quality_filter(docs: DataFrame, least_chars: int = 200, least_core: float = 0.5, profile=t.TELUGU) -> DataFrame:
    """(doc_id, chars, core_chars): documents long enough with enough of their characters in the core script."""
    chars = F.length("text").cast("bigint")
    core = F.length(F.regexp_replace("text", f"[^{profile.chars}]", "")).cast("bigint")
    return docs.where("text IS NOT NULL").select("doc_id", chars.alias("chars"), core.alias("core_chars")).where((F.col("chars") >= least_chars) & (F.col("core_chars") >= least_core * F.col("chars")))


def stratified(docs: DataFrame, by: str, k: int) -> DataFrame:
    """The k documents of each stratum with the least md5 of their ids. A first cut within parts of a stratum keeps a hot stratum from one task."""
    h = F.md5(F.col("doc_id").cast("string"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    keyed = docs.select("doc_id", by, h.alias("_h"), part.alias("_p"))
    some = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_p").orderBy("_h", "doc_id"))).where(F.col("_r") <= k)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", "doc_id"))).where(F.col("_r") <= k).select("doc_id", by)


def unigram_loss(docs: DataFrame, counted: DataFrame, name: str) -> DataFrame:
    """(doc_id, name): mean code length, in bits, of each document's pieces under counts (token, n) with one added; documents without pieces have no row.

    The counts are those of a teacher or a student; a token that they lack has count 0. The distinct pieces of a document are weighted by their number.
    """
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count("*").alias("types"))
    own = cut(docs.where("text IS NOT NULL").select("doc_id", F.explode(t.pieces(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("m")))
    # tokens of many documents are joined apart
    rows = own.groupBy("token").agg(F.count("*").alias("rows")).join(counted, "token", "left")
    bits = join_counted(own, cut(rows), ["token"], "rows").crossJoin(F.broadcast(total))  # one row
    cost = F.log2((F.col("all") + F.col("types") + 1) / (F.coalesce("n", F.lit(0)) + 1))
    return bits.groupBy("doc_id").agg(F.round(F.sum(F.col("m") * cost) / F.sum("m"), 6).alias(name))


def hard_set(teacher: DataFrame, student: DataFrame, share: float = 0.2) -> DataFrame:
    """(doc_id, gap): the share of examples whose student loss exceeds the teacher's most. Joined by example; one of the two alone tells nothing.

    The threshold is the percentile of the gaps, so ties at it are left out.
    """
    g = cut(teacher.join(student, "doc_id").select("doc_id", F.round(F.col("student") - F.col("teacher"), 6).alias("gap")))
    return g.crossJoin(F.broadcast(g.agg(F.percentile("gap", F.lit(1 - share)).alias("least")))).where("gap > least").select("doc_id", "gap")  # one row


def source_quotas(docs: DataFrame, sources: DataFrame, size: int) -> DataFrame:
    """(doc_id, source): of each source in the mix as many documents as its share of size asks, or all it has; those with the least md5 of their ids.

    Quotas are rounded down. A first cut within parts of a source keeps a hot source from one task.
    """
    quota = sources.where("target_share IS NOT NULL").select("source", F.floor(F.col("target_share") * size).alias("_q"))
    h, part = F.md5(F.col("doc_id").cast("string")), F.pmod(F.xxhash64("doc_id"), F.lit(64))
    keyed = docs.select("doc_id", "source", h.alias("_h"), part.alias("_p")).join(small(quota), "source")
    some = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("source", "_p").orderBy("_h", "doc_id"))).where("_r <= _q")
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("_h", "doc_id"))).where("_r <= _q").select("doc_id", "source")


def instruction_types(conversations: DataFrame) -> DataFrame:
    """(conv_id, type) of the conversations with a question: what its first user turn is, by shape: question, list, short (three pieces or fewer) or
    statement."""
    text = F.rtrim("text")
    kind = F.when(text.rlike(r"\?[\"'”’)]*$"), "question").when(text.rlike(r"\n\s*([-*•]|\d+[.)])\s"), "list").when(F.size(t.pieces(F.col("text"))) <= 3, "short").otherwise("statement")
    first = turns(conversations).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    return first.select("conv_id", kind.alias("type"))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns that a chat can use: one of those sent again (same conversation, turn, role and text), known roles, non-blank text."""
    role = F.lower(F.trim("role"))
    clean = conversations.select("conv_id", "turn", role.alias("role"), "text").where(role.isin("system", "user", "assistant") & (F.size(t.pieces(F.col("text"))) > 0))
    return clean.distinct()


def chat_format(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): turns in order, `role: text` lines between <bos> and <eos>. Ties of a turn go by role, then text."""
    line = F.concat("role", F.lit(": "), "text")
    rows = turns(conversations).select("conv_id", F.struct("turn", "role", "text", line.alias("line")).alias("t"))
    return rows.groupBy("conv_id").agg(F.concat(F.lit("<bos>"), F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["line"]), "\n"), F.lit("<eos>")).alias("text"))


def loss_mask(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, tokens, loss_tokens): pieces of each turn and how many carry loss, those of the assistant."""
    n = F.size(t.pieces(F.col("text"))).cast("bigint")
    return turns(conversations).select("conv_id", "turn", "role", n.alias("tokens"), F.when(F.col("role") == "assistant", n).otherwise(F.lit(0).cast("bigint")).alias("loss_tokens"))


def loss_mask_tokens(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, pos, token, loss): the pieces of each turn and its <eos>, if the assistant speaks; loss is 1 on the assistant's, 0 elsewhere.

    Turns sent again count once; pos counts within a turn of one role and text.
    """
    tokens = F.when(F.col("role") == "assistant", F.concat(t.pieces(F.col("text")), F.array(F.lit("<eos>")))).otherwise(t.pieces(F.col("text")))
    rows = turns(conversations).select("conv_id", "turn", "role", F.posexplode(tokens).alias("pos", "token"))
    return rows.withColumn("loss", (F.col("role") == "assistant").cast("int"))


def format_compliance(conversations: DataFrame, pattern: str = r"[.?!।]$") -> DataFrame:
    """One row: assistant turns and the share that end as the pattern says."""
    a = turns(conversations).where("role = 'assistant'")
    return a.agg(F.count("*").alias("turns"), F.round(F.coalesce(F.avg(F.rtrim("text").rlike(pattern).cast("double")), F.lit(0.0)), 6).alias("rate"))
