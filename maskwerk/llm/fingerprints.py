"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of up to four words.

Sections end at blank lines, paragraphs at line feeds; each keeps its white space, so that a root stands
for every character. A node's digest is the digest of its children's. The root (whole_root) is made of full
digests, so that equal roots mean equal texts. The fingerprint spells a tree of shortened ones:
root/section:piece piece ...,piece ...;section:... with paragraphs between commas. Where two differ, the
branches that differ locate the edit; the likeness of two fingerprints is the Dice coefficient of their sets
of pieces. Pieces are spelled with DIGITS hex digits, so that two texts that differ in one piece have one
spelling with a chance of one in 16.8 million: compare merkle_root (whole_root) for equality. All is DataFrame expressions.

Defined results: a null text is empty, its fingerprint that of the empty text, with likeness 1 to another
empty one and 0 to the rest; documents follow each other by doc_id, nulls last, ties by text; a single
document is its own next; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwerk.llm.common import documents, text_bytes

#: Words of a piece; the pattern takes any text apart without a rest.
PIECE = r"(?:[^\x20]+\x20*){1,4}|\x20+"
DIGITS = 6
#: Text of one range of documents, and ranges at most (two levels of splitters).
RANGE_BYTES, RANGES = 16 << 20, 1 << 14
LAST = (1 << 63) - 1


def digest(x: Column, digits: int = DIGITS) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, digits)


def pieces(text: Column) -> Column:
    """Digests of a text's pieces, by section and paragraph."""
    sections = F.split(text, r"(?<=\n\n)", -1)
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: digest(x))
    return F.transform(sections, lambda s: F.transform(F.split(s, r"(?<=\n)", -1), paragraph))


def spelled(tree: Column) -> Column:
    """The fingerprint of digests by section and paragraph; tree must be a column, not an expression."""
    paragraphs = F.transform(tree, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p, "")), ","))
    nodes = F.transform(tree, lambda s: digest(F.array_join(F.transform(s, lambda p: digest(F.array_join(p, ""), 16)), ","), 16))
    body = F.array_join(F.zip_with(nodes, paragraphs, lambda n, p: F.concat_ws(":", F.substring(n, 1, DIGITS), p)), ";")
    return F.concat(F.sha2(F.array_join(nodes, ";"), 256), F.lit("/"), body)


def whole_root(text: Column) -> Column:
    """The root of the tree with full digests: SHA-256 of the sections' digests, which are of the paragraphs', which are of the pieces'."""
    joined = lambda children: F.sha2(F.array_join(children, ""), 256)
    piece = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256))
    section = lambda s: joined(F.transform(F.split(s, r"(?<=\n)", -1), lambda p: joined(piece(p))))
    return joined(F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), r"(?<=\n\n)", -1), section))


def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, "/", 1)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of pieces; 1 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def _leaves(tree: str) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree)))


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint, leaves (distinct digests of pieces) and merkle_root (full digests)."""
    out = docs.withColumn("merkle_root", whole_root(F.col(text))).withColumn("_tree", pieces(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return out.withColumns({"fingerprint": spelled(F.col("_tree")), "leaves": _leaves("_tree")}).drop("_tree")


def changed(a: Column, b: Column) -> Column:
    """Places (section, paragraph; from 0) at which two fingerprints differ, of the longer one's."""
    def parts(x: Column) -> Column:
        sections = F.split(F.substring_index(x, "/", -1), ";")
        return F.flatten(F.transform(sections, lambda s, i: F.transform(F.split(F.substring_index(s, ":", -1), ","), lambda p, k: F.struct(i.alias("section"), k.alias("paragraph"), p.alias("p")))))

    both = F.concat(F.array_except(parts(a), parts(b)), F.array_except(parts(b), parts(a)))
    return F.array_sort(F.array_distinct(F.transform(both, lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))))


def _ranges(docs: DataFrame) -> Column:
    """A number for each document's range of ids, from approximate quantiles of the ids."""
    got = docs.agg(F.sum(text_bytes()), F.count("doc_id")).first()
    count = int(min(RANGES, max(1, -(-int(got[0] or 0) // RANGE_BYTES), got[1] // 4096)))
    points = docs.agg(F.percentile_approx("_id", [i / count for i in range(1, count)], 20 * count)).first()[0] if count > 1 else []
    points = sorted(set(points or []))
    if not points:
        return F.lit(0)
    step = max(1, round(len(points) ** 0.5))
    rows = [points[i : i + step] for i in range(0, len(points), step)]
    below = lambda xs: F.size(F.filter(xs, lambda p: p <= F.col("_id")))
    heads = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    table = F.array(*[F.array(*[F.lit(p).cast("long") for p in r]) for r in rows])
    return F.when(below(heads) == 0, 0).otherwise((below(heads) - 1) * step + below(F.get(table, below(heads) - 1)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, _text, fingerprint, merkle_root, leaves, and of the next document next_text and next_leaves.

    Ranges of ids are windows; the first document of each range is also sent to the range before it, and
    the very first to the last. Heads of ranges, RANGES at most, are broadcast.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"))
    number = _ranges(base.select("_id", F.col("_text").alias("text"), "doc_id"))
    base = base.withColumn("_range", number.cast("int"))
    firsts = base.groupBy("_range").agg(F.min("_id").alias("_head"))
    # A row for each range: RANGES at most in this one window.
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("_head", F.coalesce(F.lag("_range").over(order), F.max("_range").over(whole)).alias("_before"))
    rows = fingerprinted(base, "_text").join(F.broadcast(heads), F.col("_id") == F.col("_head"), "left")
    copies = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("guest")))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.slice(copies, 1, 1)).otherwise(copies)))
    rows = rows.select("doc_id", "_id", "_text", "fingerprint", "merkle_root", "leaves", F.col("_to.r").alias("_r"), F.col("_to.guest").alias("_guest"))
    window = Window.partitionBy("_r").orderBy("_guest", "_id", "_text")
    return rows.withColumns({"next_text": F.lead("_text").over(window), "next_leaves": F.lead("leaves").over(window)}).filter("_guest = 0")


def edited(docs: DataFrame) -> DataFrame:
    """Each document with the text whose last quarter is replaced by the next document's beginning."""
    out = with_next(docs).withColumn("n_chars", F.length("_text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    text = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    out = out.withColumn("edited_text", text).withColumn("_tree", pieces(F.col("edited_text")))
    return out.withColumns({"edited_fingerprint": spelled(F.col("_tree")), "edited_leaves": _leaves("_tree")})


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        "merkle_root",
    )


#: The same for DuckDB.
ORACLE_SQL = r"""
with base as (
    select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n,
        coalesce(lead(coalesce(text, '')) over (order by doc_id, text), first_value(coalesce(text, '')) over (order by doc_id, text)) as nt
    from documents
), texts as (select *, left(t, n - n // 4) || left(nt, n // 4) as e from base),
trees as (
    select *, list_transform([t, e, nt], lambda x:
        list_transform(regexp_split_to_array(replace(x, chr(10) || chr(10), chr(10) || chr(10) || chr(1)), chr(1)), lambda s:
            list_transform(regexp_split_to_array(replace(s, chr(10), chr(10) || chr(1)), chr(1)), lambda p:
                list_transform(regexp_extract_all(p, '(?s)(?:[^\x20]+\x20*){1,4}|\x20+'), lambda w: md5(w)[1:6])))) as trees
    from texts
), spelled as (
    select *, list_transform(trees, lambda tree: sha256(list_aggregate(list_transform(tree, lambda s:
            md5(list_aggregate(list_transform(s, lambda p: md5(coalesce(list_aggregate(p, 'string_agg', ''), ''))[1:16]), 'string_agg', ','))[1:16]), 'string_agg', ';'))
        || '/' || list_aggregate(list_transform(tree, lambda s:
            md5(list_aggregate(list_transform(s, lambda p: md5(coalesce(list_aggregate(p, 'string_agg', ''), ''))[1:16]), 'string_agg', ','))[1:6]
            || ':' || list_aggregate(list_transform(s, lambda p: coalesce(list_aggregate(p, 'string_agg', ''), '')), 'string_agg', ',')), 'string_agg', ';')) as prints,
        list_transform(trees, lambda tree: list_distinct(flatten(flatten(tree)))) as leaves,
        sha256(list_aggregate(list_transform(regexp_split_to_array(replace(t, chr(10) || chr(10), chr(10) || chr(10) || chr(1)), chr(1)), lambda s:
            sha256(list_aggregate(list_transform(regexp_split_to_array(replace(s, chr(10), chr(10) || chr(1)), chr(1)), lambda p:
                sha256(coalesce(list_aggregate(list_transform(regexp_extract_all(p, '(?s)(?:[^\x20]+\x20*){1,4}|\x20+'), lambda w: sha256(w)), 'string_agg', ''), ''))), 'string_agg', ''))), 'string_agg', '')) as merkle_root
    from trees
)
select doc_id, n as n_chars, sha256(e) as edited_sha256, prints[1] as fingerprint, prints[2] as edited_fingerprint,
    case when len(leaves[1]) + len(leaves[2]) = 0 then 1.0::double else 2.0::double * len(list_intersect(leaves[1], leaves[2])) / (len(leaves[1]) + len(leaves[2])) end as near_edited,
    case when len(leaves[1]) + len(leaves[3]) = 0 then 1.0::double else 2.0::double * len(list_intersect(leaves[1], leaves[3])) / (len(leaves[1]) + len(leaves[3])) end as near_next,
    merkle_root
from spelled
"""
