"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only.

Sections are what stands between empty lines, paragraphs the lines of a
section. Below a paragraph the tree is cut by content: a run ends with a word
whose CRC-32 is divisible by 4, a stretch with a run whose hash begins with 0.
So a word put in or taken out changes its own run, the stretch around it and
what stands above, and no other node, wherever in the paragraph it is. (A word
keeps the blanks behind it; in scripts without blanks each sign is one.)

A run's hash is its SHA-256, every other node's that of its children's hashes:
equal roots mean equal texts, and where two trees differ only the branches below
differing hashes have to be looked at. The leaves are the runs; the likeness of
two fingerprints is the share of leaves they have in common.

A fingerprint is written ``root/section:paragraph;stretch.runs;stretch.runs:paragraph.../section...``.

Results for odd input: a null text is an empty one (a tree of one empty
paragraph); equal texts have equal fingerprints and likeness 1; two texts
without any word have likeness 1 if equal, else 0; rows that repeat a doc_id
share the next document, of which the smallest text counts if it is repeated; a
null doc_id comes first; a single document is its own next; other columns are
not looked at; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwright.llm.common import text_or_empty
from epochwright.operators.indexing import number_rows
from epochwright.session import materialize, sized

UNIT = (
    r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]\s*"
    r"|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]+\s*|\s+"
)
WORDS_A_RUN = 4  # on average
_NO_ID = -(2**63)  # stands for a null doc_id in joins


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` goes through its elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grouped(items: Column, ends) -> Column:
    """Consecutive items as an array of arrays, each ending with an item of which ``ends`` is true, or the last."""

    def cut(xs: Column) -> Column:
        places = F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(xs)))
        last = F.filter(places, lambda i: (i == F.size(xs)) | ends(F.get(xs, i - 1)))
        return _once(last, lambda at: F.transform(at, lambda end, j: part(xs, at, end, j)))

    def part(xs: Column, at: Column, end: Column, j: Column) -> Column:
        before = F.coalesce(F.get(at, j - 1), F.lit(0))
        return F.slice(xs, before + 1, end - before)

    return _once(items, cut)


def _hash_of(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ","), 256)


def _paragraph(text: Column) -> Column:
    words = grouped(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda w: F.crc32(w) % WORDS_A_RUN == 0)
    runs = F.transform(words, lambda run: F.sha2(F.array_join(run, ""), 256))
    stretches = F.transform(
        grouped(runs, lambda h: h.startswith("0")), lambda part: F.struct(_hash_of(part).alias("hash"), part.alias("runs"))
    )
    return _once(
        stretches,
        lambda parts: F.struct(
            _hash_of(F.transform(parts, lambda p: p["hash"])).alias("hash"), parts.alias("stretches")
        ),
    )


def paragraph_tree(text: Column) -> Column:
    """array<array<struct<hash, stretches: array<struct<hash, runs>>>>>: paragraphs by section."""
    return F.transform(F.split(text, "\n\n"), lambda section: F.transform(F.split(section, "\n"), _paragraph))


def section_hashes(tree: Column) -> Column:
    return F.transform(tree, lambda section: _hash_of(F.transform(section, lambda p: p["hash"])))


def root_hash(sections: Column) -> Column:
    return _hash_of(sections)


def runs_of(tree: Column) -> Column:
    """The leaves of a tree as short hashes, each once."""
    stretches = F.flatten(F.transform(F.flatten(tree), lambda p: p["stretches"]))
    return F.array_distinct(F.transform(F.flatten(F.transform(stretches, lambda s: s["runs"])), lambda r: F.hash(r)))


def written(root: Column, sections: Column, tree: Column) -> Column:
    """The fingerprint as text: hashes of the branches shortened to 16 digits, runs to 8."""
    short = lambda h, n: F.substring(h, 1, n)
    stretches = lambda p: F.array_join(
        F.transform(
            p["stretches"],
            lambda t: F.concat(
                F.lit(";"), short(t["hash"], 16), F.lit("."), F.array_join(F.transform(t["runs"], lambda r: short(r, 8)), "")
            ),
        ),
        "",
    )
    section = lambda s, i: F.concat(
        F.lit("/"),
        short(F.get(sections, i), 16),
        F.array_join(F.transform(s, lambda p: F.concat(F.lit(":"), short(p["hash"], 16), stretches(p))), ""),
    )
    return F.concat(root, F.array_join(F.transform(tree, section), ""))


def likeness(root_a: Column, runs_a: Column, root_b: Column, runs_b: Column) -> Column:
    """1 for equal roots, else the share of their distinct runs that they have in common."""
    common = F.size(F.array_intersect(runs_a, runs_b))
    both = F.size(runs_a) + F.size(runs_b)
    share = F.when(both == 0, F.lit(0.0)).otherwise(2 * common / F.greatest(both, F.lit(1)))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(share.cast("double"))


def changed_stretches(tree_a: Column, tree_b: Column) -> Column:
    """Positions (section, paragraph, stretch) in the first tree of stretches that the second does not hold.

    Goes down from the sections: branches whose hash the second tree holds are
    passed over as wholes, only differing ones are opened.
    """
    place = "array<struct<section:int,paragraph:int,stretch:int>>"
    nothing = F.array().cast(place)
    hashes = lambda nodes: F.transform(nodes, lambda n: n["hash"])
    below = lambda tree: F.flatten(F.transform(F.flatten(tree), lambda p: p["stretches"]))

    def walk(new: Column) -> Column:
        here = section_hashes(tree_a)
        kept = section_hashes(tree_b)
        return F.flatten(
            F.transform(
                tree_a,
                lambda s, i: F.when(F.array_contains(kept, F.get(here, i)), nothing).otherwise(
                    F.flatten(F.transform(s, lambda p, j: in_paragraph(p, i, j, new)))
                ),
            )
        )

    def in_paragraph(p: Column, i: Column, j: Column, new: Column) -> Column:
        places = F.filter(
            F.transform(
                p["stretches"],
                lambda t, k: F.when(
                    F.array_contains(new["stretches"], t["hash"]),
                    F.struct(i.alias("section"), j.alias("paragraph"), k.alias("stretch")),
                ),
            ),
            lambda at: at.isNotNull(),
        )
        return F.when(F.array_contains(new["paragraphs"], p["hash"]), places.cast(place)).otherwise(nothing)

    return _once(
        F.struct(
            F.array_except(hashes(F.flatten(tree_a)), hashes(F.flatten(tree_b))).alias("paragraphs"),
            F.array_except(hashes(below(tree_a)), hashes(below(tree_b))).alias("stretches"),
        ),
        walk,
    )


def fingerprints(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, root, sections, tree and the written fingerprint of every row."""
    text = text_or_empty() if text is None else text
    return (
        docs.select("doc_id", paragraph_tree(text).alias("tree"))
        .withColumn("sections", section_hashes(F.col("tree")))
        .withColumn("root", root_hash(F.col("sections")))
        .withColumn("fingerprint", written(F.col("root"), F.col("sections"), F.col("tree")))
    )


def next_documents(rows: DataFrame) -> DataFrame:
    """(_id, _to, take): the document after ``_to`` in ascending id is ``_id``; the first follows the last.

    ``take`` is a quarter of the longest text with id ``_to``. Only ids and
    lengths are moved.
    """
    ids = rows.groupBy("_id").agg(F.max(F.length("_text")).alias("_n"))
    placed = materialize(number_rows(ids, [], ["_id"], out="_at"), "document-order")
    total = placed.count()
    after = placed.select(((F.col("_at") - 1 + total) % max(total, 1)).alias("_at"), F.col("_id").alias("_next"))
    return placed.join(after, "_at").select(
        F.col("_next").alias("_id"), F.col("_id").alias("_to"), F.floor(F.col("_n") / 4).cast("int").alias("take")
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document with its text, the start of the next one, and the next one's root and runs.

    Texts are moved once, by id: the same exchange (of the same columns) serves
    the rows themselves and the join that sends each document's start to the
    one before it.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"),
        text_or_empty().alias("_text"),
    )
    # a test of the row before, as a limit on row numbers would be put below the exchange
    before = F.lag(F.lit(1)).over(Window.partitionBy("_id").orderBy("_text"))
    once = rows.withColumn("_before", before).filter(F.col("_before").isNull())
    heads = (
        once.join(sized(next_documents(rows), "next-documents"), "_id")
        .select(
            F.col("_to").alias("_id"),
            F.substring("_text", F.lit(1), F.col("take")).alias("_head"),
            paragraph_tree(F.col("_text")).alias("_tree"),
        )
        .select("_id", "_head", root_hash(section_hashes(F.col("_tree"))).alias("_next_root"), runs_of(F.col("_tree")).alias("_next_runs"))
    )
    doc_id = F.when(F.col("_id") != _NO_ID, F.col("_id")).alias("doc_id")
    return rows.join(heads, "_id").select(doc_id, "_text", "_head", "_next_root", "_next_runs")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last quarter replaced by as many code points from
    the start of the next document (or all of it, if that is shorter).
    """
    n = F.length("_text")
    cut = F.floor(n / 4).cast("int")
    pairs = with_edits(docs).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "_text",
        F.concat(
            F.substring("_text", F.lit(1), n - cut), F.substring("_head", F.lit(1), cut)
        ).alias("_edited"),
        "_next_root",
        "_next_runs",
    )
    trees = pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        paragraph_tree(F.col("_text")).alias("_tree"),
        paragraph_tree(F.col("_edited")).alias("_edited_tree"),
        "_next_root",
        "_next_runs",
    )
    hashed = trees.select(
        "*",
        section_hashes(F.col("_tree")).alias("_sections"),
        section_hashes(F.col("_edited_tree")).alias("_edited_sections"),
        runs_of(F.col("_tree")).alias("_runs"),
        runs_of(F.col("_edited_tree")).alias("_edited_runs"),
    )
    rooted = hashed.select(
        "*", root_hash(F.col("_sections")).alias("_root"), root_hash(F.col("_edited_sections")).alias("_edited_root")
    )
    col = F.col
    return rooted.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(col("_root"), col("_sections"), col("_tree")).alias("fingerprint"),
        written(col("_edited_root"), col("_edited_sections"), col("_edited_tree")).alias("edited_fingerprint"),
        likeness(col("_root"), col("_runs"), col("_edited_root"), col("_edited_runs")).alias("near_edited"),
        likeness(col("_root"), col("_runs"), col("_next_root"), col("_next_runs")).alias("near_next"),
        F.size(changed_stretches(col("_edited_tree"), col("_tree"))).cast("long").alias("changed_stretches"),
    )
