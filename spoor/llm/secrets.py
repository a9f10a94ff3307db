"""Secret scan with multipart credential linking. Built-in functions only.

Strong patterns are reported wherever they match. Weak ones (an account name, a short key, an
address) mean little alone: they are joined by interval with the parts around them, and reported
only if identifier and secret come together, with a strong part or an endpoint among them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoor.llm.common import materialize

#: Parts further apart than so many code points are not linked.
REACH = 160
MASK = "<secret>"


@dataclass(frozen=True)
class Part:
    kind: str
    role: str
    strong: bool
    pattern: str
    group: int = 0
    least: int = 1


#: The three strong patterns; then the weak ones. In order of their kinds.
PARTS = (
    Part("assign", "secret", True, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Part("access", "identifier", True, r"AKIA[A-Z0-9]+", 0, 20),
    Part("hex", "secret", True, r"[0-9a-f]{24,}"),
    Part("account", "identifier", False, r"""(?i:\b(?:user(?:_?name)?|login|account|client_id|key_id|access_key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9@._-]+)""", 1, 3),
    Part("key", "secret", False, r"""(?i:\b(?:pwd|pass|auth|bearer|credentials?|private_key|key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Part("endpoint", "endpoint", False, r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis)://[^\s"'<>]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b(?::[0-9]+)?"""),
)
#: A text without any of these has no part: one cheap pass that spares most texts the others.
HINT = r"""(?i:password|passwd|secret|token|api_?key|user|login|account|client_id|key_id|access_key|pwd|pass|auth|bearer|credentials?|key)["']?\x20*[:=]|(?i:name)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|://|[0-9]\.[0-9]{1,3}\.[0-9]"""


def scan(docs: DataFrame) -> DataFrame:
    """All parts of the documents: ``doc_id, tie, kind, place, role, strong, start, end`` (code
    points, end exclusive), each once for rows that repeat. ``tie`` is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text")).where(F.col("text").rlike(HINT))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # only tells rows that repeat apart, within this scan
    lists = []
    for place, p in enumerate(PARTS):
        pattern = F.lit(p.pattern)
        found = F.arrays_zip(
            F.transform(F.split("text", p.pattern, -1), F.char_length).alias("gap"),
            F.transform(F.regexp_extract_all("text", pattern, 0), F.char_length).alias("length"),
            F.transform(F.regexp_extract_all("text", pattern, p.group), F.char_length).alias("inner"),
        )
        lists.append(F.transform(found, _numbered(place)))
    rows = rows.select("doc_id", "tie", "row", F.explode(F.concat(*lists)).alias("x")).select("doc_id", "tie", "row", "x.*").where("length is not null")
    before = Window.partitionBy("doc_id", "tie", "row", "place").orderBy("number")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    of_place = lambda f: F.element_at(F.array(*[F.lit(f(p)) for p in PARTS]), F.col("place") + 1)
    rows = rows.where(F.col("inner") >= of_place(lambda p: p.least))
    return rows.select(
        "doc_id", "tie", of_place(lambda p: p.kind).alias("kind"), "place", of_place(lambda p: p.role).alias("role"), of_place(lambda p: p.strong).alias("strong"), (F.col("end") - F.col("length")).cast("long").alias("start"), F.col("end").cast("long").alias("end")
    ).distinct()


def _numbered(place: int):
    return lambda x, i: F.struct(F.lit(place).alias("place"), i.alias("number"), x["gap"].alias("gap"), x["length"].alias("length"), x["inner"].alias("inner"))


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts to report.

    Each part meets those that start inside it or within ``reach`` behind it: an equi-join on bins of
    ``reach`` code points with the exact interval as condition. Matches of one kind do not overlap, so a
    bin holds a bounded number of parts. A weak part counts if, with its neighbours, there are an identifier and
    a secret, and one of them is strong or there is an endpoint.
    """
    key = ["doc_id", "tie", "place", "start"]
    first = parts.select("doc_id", "tie", "place", "role", "strong", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach) + 1)).alias("bin"))
    second = parts.select(*[F.col(c).alias(f"o_{c}") for c in ("doc_id", "tie", "place", "role", "strong", "start", "end")], F.floor(F.col("start") / reach).alias("o_bin"))
    pairs = first.join(
        second,
        F.col("doc_id").eqNullSafe(F.col("o_doc_id"))
        & F.col("tie").eqNullSafe(F.col("o_tie"))
        & (F.col("bin") == F.col("o_bin"))
        & (F.col("o_start") >= F.col("start"))
        & (F.col("o_start") - F.col("end") <= reach)
        & (F.col("role") != F.col("o_role")),
    )
    there = pairs.select(*key, F.col("o_role").alias("near"), F.col("o_strong").alias("near_strong"))
    back = pairs.select(F.col("o_doc_id").alias("doc_id"), F.col("o_tie").alias("tie"), F.col("o_place").alias("place"), F.col("o_start").alias("start"), F.col("role").alias("near"), F.col("strong").alias("near_strong"))
    own = parts.where(~F.col("strong")).select(*key, F.col("role").alias("near"), F.lit(False).alias("near_strong"))
    around = own.unionByName(there).unionByName(back).groupBy(*key).agg(
        F.max(F.col("near") == "identifier").alias("identifier"), F.max(F.col("near") == "secret").alias("secret"), F.max(F.col("near") == "endpoint").alias("endpoint"), F.max("near_strong").alias("near_strong")
    )
    around = around.where(F.col("identifier") & F.col("secret") & (F.col("near_strong") | F.col("endpoint")))
    weak = parts.where(~F.col("strong"))
    return weak.join(
        around.select(*[F.col(c).alias(f"a_{c}") for c in key]),
        weak["doc_id"].eqNullSafe(F.col("a_doc_id")) & weak["tie"].eqNullSafe(F.col("a_tie")) & (weak["place"] == F.col("a_place")) & (weak["start"] == F.col("a_start")),
        "left_semi",
    )


def reported(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts to report: all strong ones and the linked weak ones."""
    parts = materialize(scan(docs), "secret-parts")
    return parts.where("strong").unionByName(linked(parts, reach))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    spans: kind:start:end of everything reported, by start, then kind in the order of PARTS. A null
    text counts as empty; rows that repeat, null ids included, each get the result of their text. An
    empty table gives an empty one.
    """
    found = reported(docs, reach)
    base = F.sort_array(F.collect_list(F.when(F.col("place") < 3, F.struct("start", "place", "kind", "end"))))
    every = F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end")))
    count = lambda place: F.sum((F.col("place") == place).cast("long"))
    found = found.groupBy("doc_id", "tie").agg(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), joined(base).alias("base"), joined(every).alias("spans"))
    found = found.withColumnRenamed("doc_id", "f_doc_id").withColumnRenamed("tie", "f_tie")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
    rows = rows.join(found.hint("merge"), rows["doc_id"].eqNullSafe(found["f_doc_id"]) & rows["tie"].eqNullSafe(found["f_tie"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce(F.col("base"), F.lit("")), 256).alias("base_sha256"), F.coalesce(F.col("spans"), F.lit("")).alias("spans"))


def redact(docs: DataFrame, reach: int = REACH, mask: str = MASK) -> DataFrame:
    """The documents with every reported span replaced by ``mask``; spans that overlap become one.
    Columns and rows stay; documents without a span stay as they are."""
    found = reported(docs, reach)
    order = Window.partitionBy("doc_id", "tie").orderBy("start", "end")
    reach_so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", F.coalesce((F.col("start") >= reach_so_far).cast("int"), F.lit(1)))
    found = found.withColumn("number", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.groupBy("doc_id", "tie", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = found.groupBy(F.col("doc_id").alias("_doc_id"), F.col("tie").alias("_tie")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    rows = docs.join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & F.xxhash64("text").eqNullSafe(F.col("_tie")), "left")
    last = F.when(F.size("_cuts") > 0, F.element_at("_cuts", -1)["end"]).otherwise(F.lit(0))
    pieces = F.transform("_cuts", lambda c, i: F.substring(F.col("text"), (F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_cuts"), i - 1)["end"]) + 1).cast("int"), (c["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_cuts"), i - 1)["end"])).cast("int")))
    tail = F.substring(F.col("text"), (last + 1).cast("int"), F.char_length("text"))
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, mask), F.lit(mask), tail))
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
