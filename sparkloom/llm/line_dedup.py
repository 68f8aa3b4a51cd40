"""Line dedup: lines within a few edits of each other, by a segment-partition join.

Built of DataFrame functions alone. A line may differ by one edit in ``chars_per_edit``
characters of the shorter line, ``edits`` at most; so a very short one by none. Lines at
most t edits apart agree exactly on one of the t + 1 even segments of the shorter one, at
a place that the edits to its left and right bound. Each line gives its own segments' hashes as an index (keyed
by its length) and, for every length that it may be near to, the substrings in those
places as probes. Lines that share a key are candidates; the counts of their
characters bound their distance from below, and a banded bit-parallel edit distance
decides. Keys held by many lines are cut into blocks that meet pair by pair, after a
first round that links each key's lines to one of them: pairs in one component
already are not looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NOT_WS, at_most, components, durable, let, maybe_broadcast, names_beside, without_lines, words

#: Characters counted one by one for the lower bound, the others together; any are right, those that tell lines apart are sharp.
COUNTED = "etaonirshdlcum gfpwybvkxjqz"
BLOCK = 256
#: Rows up to which a counted side is broadcast, and salts where it is more; occurrences from which a line is dealt over salts.
SMALL, SALTS, HOT = 200_000, 64, 1000
#: Bits of a bitmap's row (fixed in Spark), bits for an entry, and rows at most: 16 MB.
BITS, SPARSE, SLOTS = 32_768, 16, 4096


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts longer than ``edits`` are at most so many edits apart (insert, delete, substitute).

    One bit to a diagonal of the band of 2 * edits + 1, slid down with each character
    of ``b``: first the band's lowest diagonal carries the distance, then a's last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    bit = lambda x, k: F.when(x.bitwiseAND(F.lit(1 << k)) != 0, 1).otherwise(0)
    inv = lambda x: F.lit(full) - x.bitwiseAND(F.lit(full))

    def distance(p: Column) -> Column:
        def matches(c: Column, i: Column) -> Column:
            terms = [F.when(F.get(p["chars"], i + (k - edits)) == c, 1 << k).otherwise(0) for k in range(width)]
            out = terms[0]
            for t in terms[1:]:
                out = out + t
            return F.struct(out.alias("m"), i.alias("i"))

        def column(s: Column, x: Column) -> Column:
            vp, vn, m = s["vp"], s["vn"], x["m"]
            d0 = (m.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def across(d: Column) -> Column:
                flat = F.struct(vn.bitwiseOR(inv(d.bitwiseOR(vp))).alias("hp"), d.bitwiseAND(vp).alias("hn"))

                def down(h: Column) -> Column:
                    row = p["n"] - 1 - x["i"] + edits
                    at = lambda v: F.call_function("shiftright", v, row).bitwiseAND(F.lit(1))
                    low = F.when(x["i"] < p["n"] - edits, 1 - bit(d, width - 1)).when(row >= 0, at(h["hp"]) - at(h["hn"])).otherwise(0)
                    half = F.shiftright(d, 1)
                    return F.struct(
                        h["hn"].bitwiseOR(inv(half.bitwiseOR(h["hp"]))).alias("vp"),
                        half.bitwiseAND(h["hp"]).alias("vn"),
                        (s["dist"] + low).alias("dist"),
                    )

                return let(flat, down)

            return let(d0, across)

        start = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("dist"))
        return F.aggregate(F.transform(F.split(b, ""), matches), start, column, lambda s: s["dist"] <= edits)

    return let(F.struct(F.split(a, "").alias("chars"), F.length(a).alias("n")), distance)


def near_pairs(pairs: DataFrame, edits: int, chars_per_edit: int = 0) -> DataFrame:
    """The rows of (a, b, la, lb) whose lines are within the edits that their length allows."""
    gap = F.abs(F.length("la") - F.length("lb"))
    if not chars_per_edit:
        return pairs.where(gap <= edits).where(within_edits(F.col("la"), F.col("lb"), edits)).select("a", "b")
    near = F.lit(False)
    for most in range(1, edits + 1):
        near = F.when(F.least(F.length("la"), F.length("lb")) >= most * chars_per_edit, (gap <= most) & within_edits(F.col("la"), F.col("lb"), most)).otherwise(near)
    return pairs.where(gap <= edits).where(near).select("a", "b")


def lines_of(docs: DataFrame) -> DataFrame:
    """A row per line with a word: doc_id, th (hash of the text), pos, line (trimmed), lh (its hash)."""
    out = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    out = out.where(F.col("line").rlike(NOT_WS)).withColumn("line", F.btrim("line", F.lit(" \t\x0b\x0c\r")))
    return out.withColumn("lh", F.xxhash64("line"))


def segment_keys(lines: DataFrame, edits: int, chars_per_edit: int) -> DataFrame:
    """Index and probe keys of (lh, line): key, lh, line, index (whether from the line's own partition). A row a line and key from the start: one short expression makes them all."""
    moves = [
        F.struct(*(F.lit(v).alias(c) for c, v in (("most", most), ("shorter", shorter), ("i", i), ("move", move))))
        for most in range(1, edits + 1) for shorter in range(most + 1) for i in range(most + 1)
        for move in range(max(-i, shorter - (most - i)), min(i, shorter + most - i) + 1)
    ]
    rows = lines.withColumn("n", F.length("line")).select("lh", "line", "n", F.inline(F.array(*moves))).withColumn("n", F.col("n") - F.col("shorter"))
    rows = rows.where((F.col("n") >= F.col("most") * chars_per_edit) & ((F.col("most") == edits) | (F.col("n") < (F.col("most") + 1) * chars_per_edit)))
    rows = rows.withColumns({"base": F.expr("int(n div (most + 1))"), "even": F.expr("most + 1 - int(n % (most + 1))")})
    start = F.col("i") * F.col("base") + F.greatest(F.lit(0), F.col("i") - F.col("even"))
    seg = F.col("base") + F.when(F.col("i") >= F.col("even"), 1).otherwise(0)
    key = F.xxhash64("most", "n", "i", F.substring(F.col("line"), start + F.col("move") + 1, seg))
    return rows.select(key.alias("key"), "lh", "line", ((F.col("shorter") == 0) & (F.col("move") == 0)).alias("index"))


def met_keys(keys: DataFrame) -> DataFrame:
    """The keys that an index row of a line shares with another line, and few that only one line has.

    A line counts by 40 bits of its hash, negative in index rows: two small numbers a key are shuffled.
    """
    mark = F.col("lh").bitwiseAND(F.lit((1 << 40) - 1)) + 1
    signed = F.when(F.col("index"), -mark).otherwise(mark)
    return keys.groupBy("key").agg(F.min(signed).alias("low"), F.max(signed).alias("high")).where("low < 0 and low <> high").select("key")


def met_members(lines: DataFrame, keys: DataFrame, met: DataFrame) -> DataFrame:
    """The lines of the keys ``met``: key, lh, index, line. Where the keys are too many to be broadcast, numbers alone are shuffled for all keys, and texts once a line."""
    if at_most(met, SMALL * 5):
        return keys.join(F.broadcast(met), "key", "left_semi").groupBy("key", "lh").agg(F.max("index").alias("index"), F.min("line").alias("line"))
    found = durable(keys.select("key", "lh", "index").join(met, "key", "left_semi").groupBy("key", "lh").agg(F.max("index").alias("index")))
    texts = lines.join(maybe_broadcast(found.select("lh").distinct(), SMALL * 5), "lh", "left_semi").groupBy("lh").agg(F.min("line").alias("line"))
    return found.join(durable(texts), "lh").select("key", "lh", "index", "line")


def counts(line: Column) -> Column:
    """How often a line has each character of COUNTED, and any other."""
    each = F.array(*(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED))
    return let(each, lambda x: F.concat(x, F.array(F.length(line) - F.aggregate(x, F.lit(0), lambda a, y: a + y))))


def may_be_near(p: Column, q: Column, edits: int) -> Column:
    """Whether lines with these counts can be so near: an edit takes one character away at most, and brings one at most."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda a, x: a + f(x))
    return let(F.zip_with(p, q, lambda x, y: x - y), lambda d: total(d, F.abs) + F.abs(total(d, lambda x: x)) <= 2 * edits)


def line_links(docs: DataFrame, edits: int, chars_per_edit: int) -> DataFrame:
    """Components of the links between different lines: (node, component), both hashes of lines."""
    lines = lines_of(docs).where(F.length("line") >= chars_per_edit).select("lh", "line")
    keys = segment_keys(lines, edits, chars_per_edit)
    met = durable(met_keys(keys))
    members = durable(met_members(lines, keys, met).withColumn("counts", counts(F.col("line"))))

    apart = lambda p, q: may_be_near(F.col(p), F.col(q), edits)
    hubs = members.groupBy("key").agg(F.min_by(F.struct("line", "counts"), F.struct(~F.col("index"), "lh")).alias("hub"), F.count("*").alias("g"))
    hubs = durable(hubs.select("key", F.col("hub.line").alias("la"), F.col("hub.counts").alias("ca"), "g"))
    star = members.join(hubs.hint("merge"), "key").where(apart("ca", "counts")).select(F.xxhash64("la").alias("a"), F.col("lh").alias("b"), "la", F.col("line").alias("lb")).where("a <> b")
    first = durable(near_pairs(star.dropDuplicates(["a", "b"]), edits, chars_per_edit))
    label = durable(components(first, native=True)).withColumnsRenamed({"node": "lh", "component": "comp"})

    rows = members.select("key", "lh", "index", "counts").join(hubs.select("key", "g").hint("merge"), "key")
    rows = rows.join(maybe_broadcast(label, SMALL), "lh", "left").withColumn("comp", F.coalesce("comp", "lh"))
    nb = F.ceil(F.col("g") / BLOCK).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.hash("lh", "key"), nb)).withColumn("j", F.explode(F.sequence(F.lit(0), nb - 1)))
    rows = durable(rows.select("key", F.least("blk", "j").alias("bi"), F.greatest("blk", "j").alias("bj"), "blk", "lh", "comp", "index", "counts"))
    x, y = rows.alias("x"), rows.alias("y")
    second = x.join(
        y.hint("merge"),
        F.expr("x.key = y.key and x.bi = y.bi and x.bj = y.bj and x.lh < y.lh and x.comp <> y.comp and (x.index or y.index) and (x.bi = x.bj or x.blk <> y.blk)") & apart("x.counts", "y.counts"),
    )
    second = durable(second.select(F.col("x.lh").alias("a"), F.col("y.lh").alias("b")).distinct())
    texts = members.select("lh", "line").join(maybe_broadcast(second.select(F.explode(F.array("a", "b")).alias("lh")).distinct(), SMALL), "lh", "left_semi").distinct()
    texts = durable(texts)
    second = second.join(texts.select(F.col("lh").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("lh").alias("b"), F.col("line").alias("lb")), "b")
    second = durable(near_pairs(second, edits, chars_per_edit))
    return components(first.union(second), native=True)


def repeated_lines(lines: DataFrame, found: DataFrame, copies: int) -> DataFrame:
    """The lines of every class to thin out: lh, n (the line's occurrences), and doc_id, th and pos of the class's first.

    A class counts as long by its longest line: then its second occurrence goes already,
    otherwise it needs over ``copies`` of them.
    """
    per_line = lines.groupBy("lh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.max("long").alias("long"))
    # The join finds the lines where the count has put them; a line that occurs once and is linked with none is in no class to thin out.
    named = per_line.join(found.hint("merge"), F.col("lh") == F.col("node"), "left").where("n > 1 or node is not null")
    named = durable(named.select("lh", "n", "first", "long", F.coalesce("component", "lh").alias("class")))
    often = named.groupBy("class").agg(F.sum("n").alias("all"), F.min("first").alias("first"), F.max("long").alias("long"))
    often = often.where((F.col("all") > copies) | (F.col("long") & (F.col("all") > 1)))
    often = durable(often.select("class", F.col("first.doc_id").alias("first_doc"), F.col("first.th").alias("first_th"), F.col("first.pos").alias("first_pos")))
    return named.select("lh", "n", "class").join(maybe_broadcast(often, SMALL), "class").select("lh", "n", "first_doc", "first_th", "first_pos")


def removed_lines(docs: DataFrame, edits: int, chars_per_edit: int, copies: int, long_words: int, long_chars: int) -> DataFrame:
    """Per text that loses lines: d, t (doc_id and hash of the text), lost (places of the lines)."""
    found = durable(line_links(docs, edits, chars_per_edit))
    long = (F.length("line") >= long_chars) | ((F.length("line") >= 2 * long_words - 1) & (F.size(words(F.col("line"))) >= long_words))
    lines = durable(lines_of(docs).select("doc_id", "th", "pos", "lh", long.alias("long")))
    often = durable(repeated_lines(lines, found, copies))
    lines = lines.drop("long")
    if at_most(often, SMALL):
        hit = lines.join(F.broadcast(often.drop("n")), "lh")
    else:
        salts = F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        hot = maybe_broadcast(durable(often.where(F.col("n") > HOT).select("lh", F.lit(SALTS).alias("salts"))), SMALL)
        dealt = lines.join(hot, "lh", "left").withColumn("salt", F.pmod(F.hash("doc_id", "pos"), F.coalesce("salts", F.lit(1))))
        hit = dealt.join(often.withColumn("salt", F.explode(salts)).drop("n"), ["lh", "salt"])
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("th") == F.col("first_th")) & (F.col("pos") == F.col("first_pos"))
    return hit.where(~first).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set("pos").alias("lost"))


def bitmap(hashes: DataFrame, h: str) -> tuple[DataFrame, int]:
    """The hashes as a bit each, some SPARSE bits a row as far as SLOTS goes: slot, bits (32,768 of them), and the number of slots."""
    slots = min(hashes.count() * SPARSE // BITS + 1, SLOTS)
    return hashes.select(F.pmod(h, F.lit(slots)).alias("slot"), bit_of(F.col(h)).alias("bit")).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits")), slots


def bit_of(h: Column) -> Column:
    return F.call_function("shiftright", h, F.lit(40)).bitwiseAND(F.lit(BITS - 1))


def in_bitmap(bits: Column, h: Column) -> Column:
    """Whether a hash has its bit: all that the bitmap was made of, and few others."""
    bit = bit_of(h).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def thinned(docs: DataFrame, edits: int = 2, chars_per_edit: int = 15, copies: int = 6, long_words: int = 20, long_chars: int = 100) -> tuple[DataFrame, str, str]:
    """``docs`` without the later occurrences of repeated lines and with two more columns, whose names come along: lines kept, lines lost."""
    d, t, lost, n_kept, n_lost, slot, bits = names_beside(docs, "d", "t", "lost", "n_kept", "n_lost", "slot", "bits")
    gone = durable(removed_lines(docs, edits, chars_per_edit, copies, long_words, long_chars)).withColumnsRenamed({"d": d, "t": t, "lost": lost})
    # Texts that lose no line stay where they lie: a bit a text, broadcast, tells most of them. The others meet their lost lines by a
    # join of two shuffled tables at every size: what it costs a GB is the same for all.
    marks, slots = bitmap(gone.select(F.xxhash64(d, t).alias("h")), "h")
    th = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    h = F.xxhash64(docs["doc_id"], th)
    marked = docs.join(F.broadcast(marks.withColumnsRenamed({"slot": slot, "bits": bits})), F.pmod(h, F.lit(slots)) == F.col(slot), "left")
    held = in_bitmap(F.col(bits), h)
    some = marked.where(held).drop(slot, bits)
    out = some.join(gone.hint("merge"), some["doc_id"].eqNullSafe(gone[d]) & (F.xxhash64(F.coalesce(some["text"], F.lit(""))) == gone[t]), "left")
    whole = marked.where(~held).drop(slot, bits)
    out = out.union(whole.withColumns({f.name: F.lit(None).cast(f.dataType) for f in gone.schema}))
    zero = F.lit(0).cast("long")
    n_all = F.coalesce(F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NOT_WS))).cast("long"), zero)
    out = out.withColumn(n_lost, F.when(F.col(lost).isNull(), zero).otherwise(F.size(lost).cast("long")))
    out = out.withColumn(n_kept, F.when(F.col("text").isNull(), zero).otherwise(n_all) - F.col(n_lost))
    out = out.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col(lost))))
    return out.select(*[f"`{c}`" for c in docs.columns], n_kept, n_lost), n_kept, n_lost


def line_dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the later occurrences of repeated lines; limits as in ``thinned``.

    Lines, trimmed, that differ by at most one edit in ``chars_per_edit`` characters and
    ``edits`` in all form classes (linked lines are of one class). Of a
    class that holds a line of ``long_words`` words or ``long_chars`` characters, too long
    to recur by accident, and of any other with over ``copies`` occurrences, the first
    stays, by doc_id (null first), text and place; the others go. Adds kept_lines and
    lost_lines (lines with a word), in place of columns of these names, and keeps
    every row, also those whose text is empty now. Null texts stay null with no lines;
    blank lines stay and are not counted; repeated rows are treated alike, their lines
    count as occurrences each. Lines are never shortened, whatever their length. An empty
    table gives an empty result; other columns are handed on, whatever their names.
    """
    out, n_kept, n_lost = thinned(docs, **limits)
    return out.select(*[f"`{c}`" for c in docs.columns if c not in ("kept_lines", "lost_lines")], F.col(n_kept).alias("kept_lines"), F.col(n_lost).alias("lost_lines"))
