"""Line dedup: an exact set-similarity join over the lines of all documents, in DataFrame functions only.

A line's tokens are its distinct lower-case words (what stands between blanks), ordered by rarity (quarter-octave classes of counts over the whole corpus, then hash).
Lines with equal tokens are one set, at its first place. Two sets whose Jaccard is 0.8 or more share a token within their prefixes
(n - ceil(0.8 n) + 1 rarest tokens); pairs that share one must pass the length filter, the positional filter (a shared token's places
cannot lie further apart than the tokens that may differ), a bitmap filter (bits that differ in two parity sketches are tokens that
differ) and share as many prefix tokens as the prefixes' lengths ask for. What passes is verified
by the exact Jaccard of the lines' tokens. Of each pair the later line goes; later copies of a set go as well; lines without tokens stay.

A family of thousands of similar lines must not be paired with itself: sets that share neighbouring prefix tokens are first compared with
the few earliest of them and with what those match, and only sets that found no match there look at earlier sets otherwise: postings carry
their set's id, which follows its place, and whether it is known to go, so a pair whose later set goes anyway never leaves the join. As any earlier line
is reason enough to remove a line, whether that one stays or not, the result is that of comparing all pairs.

Words are told apart by 56 bits of their hash while candidates are sought, and sets by 64 bits of theirs, their size and their sketches;
verification compares the words themselves. Counts are kept for a fixed number of hash buckets, which only affects the order.

Defined results: null text counts as empty and stays null in remove(); rows without an id keep all their lines; rows that repeat an id and a text are
one document; places are ordered by document id and line number, of sets with the same first place (of texts that share an id) either may count as earlier; extra columns stay.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, dropped, small, tidy, written

#: Sets of more tokens have a second sketch.
SHORT = 60
#: Hash buckets of the counts; pairs of neighbouring tokens by which a set finds families; a family's heads.
BUCKETS, FAMILY_PAIRS, HEADS = 1 << 18, 3, 8
#: Bits of a set's id that hold its place.
PLACE_BITS = 63
#: Bytes of a broadcast row: of an id, of a place, of a head.
ID_BYTES, PLACE_BYTES, HEAD_BYTES = 32, 64, 96


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line. A text is hashed before it is split: beside posexplode() it would be carried along with each of its lines and hashed again for each."""
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n", -1).alias("lines")).select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line"))


def words_of(line: str):
    """The words of a line, with repeats and empty ones."""
    return F.split(F.lower(F.col(line)), " ", -1)


def rarity(docs: DataFrame) -> DataFrame:
    """One row: classes, array<bigint> with the class of each bucket's count in the upper 8 bits; its size is fixed by BUCKETS. Counts are of all lines' words, from one split of each text."""
    text = docs.where("doc_id is not null").select(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("line"))
    words = text.select(F.explode(words_of("line")).alias("w"))
    counted = words.select(F.expr(f"cast(xxhash64(w) & {BUCKETS - 1} as int)").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    every = counted.unionByName(docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n")))
    every = every.groupBy("bucket").agg(F.least(F.lit(127), F.floor(4 * F.log2(F.sum("n") + 1))).cast("long").alias("class"))
    return every.agg(F.expr("transform(sort_array(collect_list(struct(bucket, class))), x -> shiftleft(x.class, 56))").alias("classes"))


def keyed(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, key, n, prefix, sketch, sketch2 of every line, written; n is 0 for a line without words."""
    spark, name = lines.sparkSession, f"line_classes_{uuid4().hex}"
    # a lambda can't hold a subquery, but it can name a session variable; the array's size is fixed by BUCKETS
    classes.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<BIGINT>")
    try:
        spark.sql(f"SET VARIABLE {name} = (SELECT classes FROM {name})")
        return written(_hashed(lines, name), "line-keys", hashes=True)
    finally:
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")


def _hashed(lines: DataFrame, classes: str) -> DataFrame:
    """The columns of keyed(). No filter on n here: it would be pushed down and the arrays computed twice."""
    # each word is hashed once and array_except() leaves distinct hashes without that of the empty word, so that classes are looked up for these only;
    # class in the upper 8 bits, hash below (never null, so that arrays stay primitive)
    words = lines.select("doc_id", "text_key", "line_no", words_of("line").alias("words"))
    distinct = "array_except(transform(words, w -> xxhash64(w)), array(xxhash64('')))"
    ordered = F.expr(f"sort_array(transform({distinct}, h -> coalesce({classes}[h & {BUCKETS - 1}] | shiftrightunsigned(h, 8), 0L)))")
    return words.select("doc_id", "text_key", "line_no", ordered.alias("t")).select(
        "doc_id",
        "text_key",
        "line_no",
        F.xxhash64("t").alias("key"),
        F.size("t").alias("n"),
        # 31 bits will do to find candidates
        F.expr("transform(slice(t, 1, size(t) - (4 * size(t) + 4) div 5 + 1), x -> cast(x & 2147483647 as int))").alias("prefix"),
        # parity of the tokens in 64 bins; for more than SHORT tokens also of half of them, so that both halves are known
        F.expr("aggregate(t, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))").alias("sketch"),
        F.expr(f"if(size(t) <= {SHORT}, 0L, aggregate(t, 0L, (a, x) -> a ^ shiftleft(shiftrightunsigned(x, 6) & 1L, cast(x & 63 as int))))").alias("sketch2"),
    )


def similar_sketches(x: str, y: str):
    """Length and bitmap filters of two sets."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = c(x, "n") + c(y, "n")
    first, second = (c(x, s).bitwiseXOR(c(y, s)) for s in ("sketch", "sketch2"))
    bits = F.when((c(x, "n") > SHORT) & (c(y, "n") > SHORT), F.bit_count(first.bitwiseXOR(second)) + F.bit_count(second)).otherwise(F.bit_count(first))
    return (5 * F.least(c(x, "n"), c(y, "n")) >= 4 * F.greatest(c(x, "n"), c(y, "n"))) & (9 * bits <= both)


def comparable(x: str, y: str):
    """Filters of two postings: of the sets, and how far the places of a shared token may lie apart; all hold for every token that two similar sets share."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = c(x, "n") + c(y, "n")
    return similar_sketches(x, y) & (9 * (c(x, "n") - c(x, "i") + c(y, "i")) >= 4 * both) & (9 * (c(y, "n") - c(y, "i") + c(x, "i")) >= 4 * both)


def words_of_sets(ids: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """id, words (distinct) of the sets in ids, read from the documents again."""
    ids = written(ids.distinct(), "line-ids")
    places = written(sets.join(small(ids, ID_BYTES), "id").select("id", "doc_id", "text_key", "line_no"), "line-places")
    few = docs.join(small(places.select(F.col("doc_id").alias("__id")).distinct(), ID_BYTES), F.col("doc_id").cast("long") == F.col("__id"), "left_semi")
    lines = lines_of(few).join(small(places, PLACE_BYTES), ["doc_id", "text_key", "line_no"])
    # rows that repeat an id and a text give a line more than once
    first = lines.groupBy("id").agg(F.first("line").alias("line"))
    words = written(first.select("id", F.expr("array_remove(array_distinct(split(lower(line), ' ', -1)), '')").alias("words")), "line-words")
    for old in (ids, places):
        dropped(old)
    return words


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """id, earlier: the later sets of pairs (later, earlier) whose words have a Jaccard of 0.8 or more, and the first that each matches."""
    side = lambda k: words.select(F.col("id").alias(k), F.col("words").alias(f"words_{k}"))
    both = pairs.join(side("later"), "later").join(side("earlier"), "earlier")
    common = F.size(F.array_intersect("words_later", "words_earlier"))
    linked = both.where(9 * common >= 4 * (F.size("words_later") + F.size("words_earlier")))
    return written(linked.groupBy(F.col("later").alias("id")).agg(F.min("earlier").alias("earlier")), "line-matches")


def distinct_sets(lines: DataFrame) -> DataFrame:
    """One row per set of words: id, key, n, sketch, sketch2, prefix, its first place (doc_id, line_no, text_key), and how many lines have it.

    Ids follow the places, so that postings need not carry them: document id and line number in one number where both fit (PLACE_BITS) and
    no document id has two texts, else numbers in the order of the places, which sorts all sets.
    """
    each = lines.groupBy("key", "n", "sketch", "sketch2").agg(F.min(F.struct("doc_id", "line_no", "text_key")).alias("place"), F.first("prefix").alias("prefix"), F.count("*").alias("lines"))
    placed = each.select("key", "n", "sketch", "sketch2", "place.*", "prefix", "lines")
    bits = line_bits(lines)
    if bits is None:
        placed = placed.orderBy("doc_id", "line_no", "text_key", "key").select(F.monotonically_increasing_id().alias("id"), "*")
    else:
        placed = placed.select(F.shiftleft("doc_id", bits).bitwiseOR(F.col("line_no").cast("long")).alias("id"), "*")
    return written(placed, "line-sets", hashes=True)


def line_bits(lines: DataFrame) -> int | None:
    """Bits of a line number in a number that also holds its document id; None where they don't fit or a document id has several texts."""
    docs = lines.groupBy("doc_id").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most"), F.max("line_no").alias("line"))
    with tidy(lines.sparkSession):
        found = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max("line"), F.max((F.col("least") != F.col("most")).cast("int"))).first()
    if found[0] is None or found[0] < 0 or found[3]:
        return None
    bits = found[2].bit_length()
    return bits if found[1].bit_length() + bits <= PLACE_BITS else None


def copies_of(lines: DataFrame, sets: DataFrame) -> DataFrame:
    """id, doc_id, text_key, line_no, again of all lines but each set's first; again: at another place (not in another text of the same id)."""
    by = ["key", "n", "sketch", "sketch2"]
    firsts = sets.where("lines > 1").select("id", *by, F.struct("doc_id", "line_no", "text_key").alias("first"))
    named = lines.join(small(firsts, 2 * PLACE_BYTES), by).where(F.struct("doc_id", "line_no", "text_key") != F.col("first"))
    again = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no"))
    return written(named.select("id", "doc_id", "text_key", "line_no", again.alias("again")), "line-copies", hashes=True)


def families(sets: DataFrame) -> DataFrame:
    """key, id, n, sketch, sketch2: sets that share a pair of neighbours among their commonest prefix tokens with another set."""
    # by place and not in a lambda, which Spark does not compile: the last pair, the one before, and so on; one token alone is a pair with null
    pairs = [F.when((F.lit(k) == 0) | (F.size("prefix") > k + 1), F.xxhash64(F.get("prefix", F.greatest(F.lit(0), F.size("prefix") - k - 2)), F.get("prefix", F.greatest(F.lit(1), F.size("prefix") - k - 1)))) for k in range(FAMILY_PAIRS)]
    each = sets.select("id", "n", "sketch", "sketch2", F.explode(F.array(*pairs)).alias("key")).where("key is not null")
    shared = written(each.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1").select("key"), "family-keys", hashes=True)
    found = written(each.join(small(shared, ID_BYTES), "key"), "families", hashes=True)
    dropped(shared)
    return found


def family_matches(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """id, earlier: sets that match one of the HEADS earliest of a family of theirs, or of a family that those lead to.

    Every member is compared with its family's earliest one, those that do not match it with the next few, and what is left then with
    the heads of other families: those of the sets that the own family's heads match. Copies that differ more fall into other families
    than the set they come from, but those families' heads mostly match it. A family never meets itself: that is a bounded number of
    comparisons per member (FAMILY_PAIRS² · HEADS² at most). What is left is left to the search over postings.
    """
    family = families(sets)
    words = words_of_sets(family.select("id"), sets, docs)
    heads = written(family.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rank") <= HEADS), "family-heads")
    matched = None

    def compared(pairs: DataFrame) -> DataFrame:
        """matched and what matches in pairs (l: the member, h: the other) among the sets that are not in matched."""
        pairs = pairs.where(similar_sketches("h", "l"))
        pairs = pairs if matched is None else pairs.join(small(matched.select("id"), ID_BYTES).alias("m"), F.col("l.id") == F.col("m.id"), "left_anti")
        pairs = written(pairs.select(F.col("l.id").alias("later"), F.col("h.id").alias("earlier")).distinct(), "family-pairs")
        found = verified(pairs, words)
        dropped(pairs)
        return found if matched is None else written(matched.unionByName(found), "line-matches")

    member = family.alias("l")
    for lowest, highest in ((1, 1), (2, HEADS)):
        head = small(heads.where(F.col("rank").between(lowest, highest)), HEAD_BYTES).alias("h")
        matched = compared(member.join(head, (F.col("l.key") == F.col("h.key")) & (F.col("l.id") > F.col("h.id"))))
    # the sets that a family's heads match, and the heads of those sets' own families
    links = small(matched.withColumnRenamed("id", "via"), PLACE_BYTES)
    links = heads.select("key", F.col("id").alias("via")).join(links, "via").select("key", F.col("earlier").alias("to")).distinct()
    onward = heads.select(F.col("id").alias("to"), F.col("key").alias("other")).join(small(links, PLACE_BYTES), "to").select("key", "other").distinct()
    steps = onward.join(heads.withColumnRenamed("key", "other"), "other").select("key", "id", "n", "sketch", "sketch2").distinct()
    steps = written(steps, "family-steps")
    matched = compared(member.join(small(steps, HEAD_BYTES).alias("h"), (F.col("l.key") == F.col("h.key")) & (F.col("l.id") > F.col("h.id"))))
    for old in (family, heads, steps, words):
        dropped(old)
    return matched


def candidates(sets: DataFrame, matched: DataFrame) -> DataFrame:
    """later, earlier, n (shared prefix tokens) of all pairs that pass the filters and whose later set is not in matched (id)."""
    known = small(matched.select("id", F.lit(True).alias("goes")), ID_BYTES)
    postings = sets.select("id", "n", "sketch", "sketch2", "prefix").join(known, "id", "left")
    postings = postings.select("id", "n", "sketch", "sketch2", F.coalesce("goes", F.lit(False)).alias("goes"), F.posexplode("prefix").alias("i", "token"))
    # the smaller set of a pair needs fewer tokens of its prefix
    x, y = postings.where("i < n - (8 * n + 8) div 9 + 1 + greatest(n div 40, cast(n >= 9 as int))").alias("x"), postings.alias("y")
    smaller = F.expr("x.n < y.n or (x.n = y.n and x.id < y.id)")
    open_ = F.expr("not if(x.id < y.id, y.goes, x.goes)")
    shared = x.join(y, (F.col("x.token") == F.col("y.token")) & smaller & open_ & comparable("x", "y"))
    # enough tokens of the prefixes must be shared; a longer prefix of the smaller set makes chance pairs fall short
    least = F.expr("(4 * (x.n + y.n) + 8) div 9")
    used_x, used_y = F.expr("x.n - (8 * x.n + 8) div 9 + 1 + greatest(x.n div 40, cast(x.n >= 9 as int))"), F.expr("y.n - (4 * y.n + 4) div 5 + 1")
    need = F.least(F.least(used_x, F.col("x.n")) - (F.col("x.n") - least), F.least(used_y, F.col("y.n")) - (F.col("y.n") - least))
    pairs = shared.select(F.greatest("x.id", "y.id").alias("later"), F.least("x.id", "y.id").alias("earlier"), need.alias("need"))
    counted = pairs.groupBy("later", "earlier").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return written(counted.where("n >= need").select("later", "earlier", "n"), "line-candidates", hashes=True)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, gone (line numbers) of the documents that lose lines."""
    lines = lines_of(docs)
    classes = written(rarity(docs), "rarity")
    all_lines = keyed(lines, classes)
    some = all_lines.where("n > 0")
    sets = distinct_sets(some)
    copies = copies_of(some, sets)
    for old in (classes, all_lines):
        dropped(old)
    matched = family_matches(sets, docs)
    # each later set's most promising pair is verified first; sets that find a match need no more
    pairs = candidates(sets, matched)
    words = words_of_sets(pairs.select(F.explode(F.array("later", "earlier")).alias("id")), sets, docs)
    best = written(pairs.groupBy("later").agg(F.max_by("earlier", F.struct("n", "earlier")).alias("earlier")), "line-best", hashes=True)
    at_once = verified(best, words)
    others = pairs.select("later", "earlier").join(small(at_once.select(F.col("id").alias("later")), ID_BYTES), "later", "left_anti").join(best, ["later", "earlier"], "left_anti")
    others = written(others, "line-others", hashes=True)
    later = written(matched.unionByName(at_once).unionByName(verified(others, words)).select("id").distinct().withColumn("goes", F.lit(True)), "later-sets")
    # a line stays if its set matches no earlier one and this is the set's first place
    goes = small(later, ID_BYTES)
    gone = copies.join(goes, "id", "left").where("again or goes").select("doc_id", "text_key", "line_no").unionByName(sets.join(goes, "id").select("doc_id", "text_key", "line_no"))
    out = written(gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("gone")), "gone-lines")
    for old in (sets, copies, matched, pairs, words, best, at_once, others, later):
        dropped(old)
    return out


def with_gone(docs: DataFrame, name: str) -> DataFrame:
    """docs and, in column `name`, the numbers of the lines that go (null: none)."""
    gone = removals(docs)
    with tidy(docs.sparkSession):
        held = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0)) * 4 + F.count("*") * PLACE_BYTES).first()[0]  # bytes
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key"), F.col("gone").alias(name))
    gone = F.broadcast(gone) if held <= BROADCAST_BYTES else gone
    key = (F.col("doc_id").cast("long") == F.col("__gone_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__gone_key"))
    return docs.join(gone, key, "left").select(*docs.columns, name)


def kept(gone: str):
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.expr(f"array_join(filter(split(text, '\n', -1), (line, i) -> not array_contains({gone}, i)), '\n')"))


def remove(docs: DataFrame) -> DataFrame:
    """docs with all their columns; text without the lines that match earlier ones, n_chars (if there) counted anew."""
    columns = {"text": kept("__gone")} | ({"n_chars": F.length(kept("__gone")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return with_gone(docs, "__gone").withColumns(columns).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every row; a null text counts as empty."""
    filled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_gone(filled, "__gone").select(
        "doc_id",
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(kept("__gone"), 256).alias("kept_sha256"),
    )
