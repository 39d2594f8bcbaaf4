"""Line dedup by a segment-partition edit join, in Spark expressions only.

A line goes if an equal line, or one within ``edits`` edits, comes earlier in
the corpus (by document id, then by place). Lines without a word, or shorter
than ``min_chars``, stay.

1. Equal lines are counted under a 96-bit hash: one row for each different line.
2. Each line is split into edits + 1 segments. If two lines are within the
   budget, some segment of the shorter one stands in the longer one at one of a
   few places that its length allows. Segments are indexed and probed under a
   hash of (length, number, characters).
3. A key with at most ``PAIRS_UP_TO`` lines yields its pairs. A hotter one is
   never expanded into pairs: its lines agree in the segment, so that what is
   left of them must be within the budget, and is split and probed in the same
   way under the key. This ends when keys are small, or lines agree in all but
   a few characters at one place.
4. Pairs are verified with a banded bit-parallel edit automaton, after common
   ends are cut off by bisection.

Places of hot lines are joined with one row a line, in a join that adaptive
execution splits. Row widths are fixed in all exchanges but those that fetch the lines to
verify and remove lines, which go by id and text.

Defined results: a null or empty text has no lines and stays as it is; rows
equal in id and text count as one document and both keep its first lines; rows
that repeat an id with another text are judged by their own text; a null id
comes first. Ids are of any type that has an order. An empty table gives an
empty result. Other columns, whatever their names, are ignored by ``dedup`` and
returned untouched by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import WORD, materialize, scratch

EDITS = 1
MIN_CHARS = 20
PAIRS_UP_TO = 64
#: A document is left to near-duplicate detection if lines of this share of it come from one earlier document, whose length is within this ratio of its own.
COPIED, LIKE_SIZE = 0.05, 0.8
_NULL_FIRST = -(1 << 63) - 1


def segments(length: str, edits: int) -> list[tuple[str, str]]:
    """SQL of (offset, size) of the edits + 1 even segments of a line; the last ones are a character longer where it doesn't divide."""
    n = edits + 1
    cut = [f"cast(({length}) * {i} div {n} AS int)" for i in range(n + 1)]
    return [(cut[i], f"({cut[i + 1]} - {cut[i]})") for i in range(n)]


def _keys(edits: int, line: str = "line", under: str = "") -> list[tuple[str, bool, int, str, str, bool]]:
    """Of each segment key of (line, n): its SQL, whether it is an index entry of the line itself, d, the SQL of where it starts and of its size, and whether it ends both lines.

    A line of n characters probes the index of lines of n - d characters at the
    places where a segment may have moved: k before it to the left and the rest
    of the budget to the right, both allowing for d.
    """
    out = []
    for d in range(edits + 1):
        for i, (offset, size) in enumerate(segments(f"n - {d}", edits)):
            low, high = max(-i, d - (edits - i)), min(i, d + (edits - i))
            for shift in range(low, high + 1):
                key = f"xxhash64({under}{i}, n - {d}, substring({line}, {offset} + {1 + shift}, {size}))"
                inside = f"{offset} + {shift} >= 0 AND {offset} + {shift} + {size} <= n AND n - {d} > {edits}"
                out.append((f"CASE WHEN {inside} THEN {key} END", d == 0 and shift == 0, d, f"({offset} + {shift})", size, i in (0, edits)))
    return out


def _trimmed(a: str, b: str) -> str:
    """SQL of (x, y): two strings without their common prefix and suffix, each found by bisection."""
    steps = "sequence(1, 1 + cast(ceil(log2(1 + least(length(p.x), length(p.y)))) AS int))"
    mid = "cast((s.lo + s.hi + 1) div 2 AS int)"

    def common(equal: str) -> str:
        return (
            f"aggregate({steps}, named_struct('lo', 0, 'hi', least(length(p.x), length(p.y))), (s, k) -> CASE WHEN s.lo >= s.hi THEN s "
            f"WHEN {equal} THEN named_struct('lo', {mid}, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', {mid} - 1) END, s -> s.lo)"
        )

    head = common(f"left(p.x, {mid}) = left(p.y, {mid})")
    tail = common(f"right(p.x, {mid}) = right(p.y, {mid})")
    first = f"transform(transform(array(named_struct('x', {a}, 'y', {b})), p -> named_struct('x', p.x, 'y', p.y, 'c', {head})), p -> named_struct('x', substring(p.x, p.c + 1), 'y', substring(p.y, p.c + 1)))"
    return f"transform(transform({first}, p -> named_struct('x', p.x, 'y', p.y, 'c', {tail})), p -> named_struct('x', left(p.x, length(p.x) - p.c), 'y', left(p.y, length(p.y) - p.c)))[0]"


def within(a: str, b: str, edits: int) -> Column:
    """Whether two string columns are at most ``edits`` edits apart.

    Bit d of word e says that e edits suffice to reach diagonal d - edits of the
    band; a step over one character updates all diagonals of a word at once.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    # In step j the character of y meets those of x at j - edits .. j + edits.
    match = " | ".join(f"CASE WHEN substring(t.x, j + {d - edits}, 1) = substring(t.y, j, 1) AND j + {d - edits} >= 1 AND j + {d - edits} <= length(t.x) THEN {1 << d} ELSE 0 END" for d in range(width))
    words = ["w[0] & m"]
    for e in range(1, edits + 1):
        # Replaced: same diagonal. Only in y: one diagonal down. Only in x: one up, within the step.
        words.append(f"((w[{e}] & m) | w[{e - 1}] | shiftright(w[{e - 1}], 1) | (shiftleft({{prev}}, 1) & {full}))")
    spelled: list[str] = []
    for e, word in enumerate(words):
        spelled.append("(" + word.replace("{prev}", spelled[e - 1] if e else "") + ")")
    step = f"element_at(transform(array({match}), m -> array({', '.join(spelled)})), 1)"
    start = ", ".join(str(sum(1 << (edits + k) for k in range(e + 1))) for e in range(edits + 1))
    alive = " + ".join(f"w[{e}]" for e in range(edits + 1))
    run = f"aggregate(sequence(1, length(t.y)), array({start}), (w, j) -> CASE WHEN {alive} = 0 THEN w ELSE {step} END, w -> (shiftright(w[{edits}], length(t.x) - length(t.y) + {edits}) & 1) = 1)"
    test = f"CASE WHEN abs(length(t.x) - length(t.y)) > {edits} THEN false WHEN length(t.y) = 0 OR length(t.x) = 0 THEN true ELSE {run} END"
    return F.expr(f"transform(array({_trimmed(a, b)}), t -> {test})[0]")


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).alias("id"), F.xxhash64(body).alias("t"), body.alias("text"))


def _order(rows: DataFrame) -> Column:
    """What lines are ordered by; for whole numbers packed into one of fixed width, so that equal lines are summed by hash before the exchange."""
    if isinstance(rows.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        number = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(_NULL_FIRST)).cast("decimal(20,0)"))
        return (number * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(32,0)")
    return F.struct("id", "pos")


def _on_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by id and text hash; null ids are equal, and dealt by their texts."""
    right = right.withColumnsRenamed({"id": "_id", "t": "_t"})
    return left.join(right, left["id"].eqNullSafe(right["_id"]) & (left["t"] == right["_t"]), how).drop("_id", "_t")


def _live(entries: DataFrame) -> DataFrame:
    """The entries of keys under which an index entry meets another, with the number ``c`` of all under the key."""
    counts = materialize(entries.groupBy("key").agg(F.count("*").alias("c"), F.sum("own").alias("o")).filter("c > 1 AND o > 0").select("key", "c"), narrow=True)
    return materialize(entries.join(counts, "key"), lasting=True)


def _entries(keys: list, own: str, keyed) -> Column:
    return F.array(*[F.struct(keyed(k).alias("key"), F.expr(f"{own} * {int(mine)}").alias("own"), F.lit(k).alias("k")) for k, (_, mine, *_) in enumerate(keys)])


def _candidates(live: DataFrame, texts: DataFrame, edits: int, pairs_up_to: int) -> tuple[DataFrame, DataFrame]:
    """(key, own, h, g) of keys small enough for all their pairs, which hold all pairs within the budget; and the texts, written if there were hot keys."""
    keys = _keys(edits)
    pick = lambda part: "CASE k " + " ".join(f"WHEN {k} THEN {x[part]}" for k, x in enumerate(keys)) + " END"
    # A segment at an end of both lines leaves one stretch; others leave two, told apart by a sign that no line has.
    mark = f"CASE WHEN k IN ({', '.join(str(k) for k, x in enumerate(keys) if x[5])}) THEN '' ELSE '\\n' END"
    enough = edits if edits == 1 else 4 * (edits + 1)
    small, level = [], live
    while True:
        small.append(level.filter(F.col("c") <= pairs_up_to).select("key", "own", "h", "g"))
        hot = level.filter(F.col("c") > pairs_up_to)
        if hot.isEmpty():
            break
        if "rest" not in hot.columns:
            texts = materialize(texts, lasting=True)
            hot = hot.join(texts.select("h", "g", F.col("line").alias("rest")), ["h", "g"])
        hot = hot.withColumn("n", F.length("rest")).withColumn("at", F.expr(pick(3))).withColumn("size", F.expr(pick(4))).withColumn("d", F.expr(pick(2)))
        hot = hot.select("key", "own", "h", "g", "d", F.expr(f"concat(left(rest, at), {mark}, substring(rest, at + size + 1))").alias("rest")).withColumn("n", F.length("rest"))
        hot = materialize(hot, lasting=True)
        small.append(hot.filter(f"n - d <= {enough}").select("key", "own", "h", "g"))
        again = _keys(edits, "rest", "key, ")
        made = _entries(again, "own", lambda k, again=again: F.expr(f"CASE WHEN d = {again[k][2]} THEN {again[k][0]} END"))
        entries = hot.filter(f"n - d > {enough}").select("h", "g", "rest", F.inline(made)).filter("key IS NOT NULL")
        level = _live(entries)
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    return out, texts


def _removed(rows: DataFrame, edits: int, min_chars: int, pairs_up_to: int, sources: bool = False) -> DataFrame:
    """(id, t, gone): for each document, the (pos, near) to remove; with ``sources`` grouped by the earlier document, as (id, t, src, src_t, src_chars, gone)."""
    keys = _keys(edits)
    lines = rows.select("id", "t", F.length("text").alias("chars"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", F.length("line"))
    lines = lines.filter((F.col("n") >= min_chars) & F.col("line").rlike(WORD))
    extra = ["chars", "n"] if sources else []
    lines = lines.select("id", "t", "pos", *extra, F.xxhash64("line").alias("h"), F.hash(F.lit(7), F.col("line")).alias("g"), *[F.expr(k[0]).alias(f"k{i}") for i, k in enumerate(keys)])
    lines = materialize(lines, lasting=True)
    placed = lines.withColumn("ord", _order(rows))
    firsts = ["id", "t", "pos", *extra[:1]]
    distinct = materialize(
        placed.groupBy("h", "g").agg(F.min("ord").alias("ord"), F.count("*").alias("cnt"), *[F.min_by(c, "ord").alias(c) for c in firsts], *[F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))]),
        lasting=not sources,
    )

    entries = distinct.select("h", "g", F.inline(_entries(keys, "1", lambda k: F.col(f"k{k}")))).filter("key IS NOT NULL")
    live = _live(entries)

    # The text of every line that shares a key, from the document where it comes first.
    wanted = distinct.select("h", "g", "ord", "id", "t", "pos").join(live.select("h", "g").distinct(), ["h", "g"], "left_semi")
    wanted = materialize(wanted.groupBy("id", "t").agg(F.collect_list(F.struct("h", "g", "ord", "pos")).alias("want")), lasting=not sources)
    fetched = _on_row(rows, wanted).select(F.expr("inline(transform(array(split(text, '\\n')), ls -> transform(want, s -> named_struct('h', s.h, 'g', s.g, 'ord', s.ord, 'line', ls[s.pos])))[0])"))
    # Not written unless needed: one plan that fetches lines and removes them exchanges the documents once.
    few, texts = _candidates(live, fetched.dropDuplicates(["h", "g"]).select("h", "g", "ord", "line"), edits, pairs_up_to)
    left = few.filter("own = 1").select("key", F.col("h").alias("h1"), F.col("g").alias("g1"))
    right = few.select("key", "own", F.col("h").alias("h2"), F.col("g").alias("g2"))
    pairs = left.join(right, "key").filter("(h1 <> h2 OR g1 <> g2) AND (own = 0 OR h1 < h2 OR (h1 = h2 AND g1 < g2))").select("h1", "g1", "h2", "g2").distinct()
    one = texts.select(F.col("h").alias("h1"), F.col("g").alias("g1"), F.col("ord").alias("o1"), F.col("line").alias("l1"))
    two = texts.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("ord").alias("o2"), F.col("line").alias("l2"))
    near = pairs.join(one, ["h1", "g1"]).join(two, ["h2", "g2"]).filter("o1 <> o2").filter(within("l1", "l2", edits))
    turned = near.select(F.expr("CASE WHEN o1 < o2 THEN struct(h2 AS h, g2 AS g, h1 AS eh, g1 AS eg, o1 AS eo) ELSE struct(h1 AS h, g1 AS g, h2 AS eh, g2 AS eg, o2 AS eo) END").alias("x")).select("x.*")
    later = turned.groupBy("h", "g").agg(F.min(F.struct("eo", "eh", "eg")).alias("e")).select("h", "g", "e.eh", "e.eg")
    if sources:  # read more than once below, and the driver would plan the search for near lines again each time
        later = materialize(later, narrow=True)

    facts = distinct.select("h", "g", "ord", "cnt", *[F.col(c).alias(f"src_{c}") for c in firsts])
    marked = facts.join(later, ["h", "g"], "left").withColumn("near", F.col("eh").isNotNull()).filter("cnt > 1 OR near")
    if sources:  # of a near line: the document of the earliest one that it is near to
        marked = materialize(marked)
        other = distinct.select(F.col("h").alias("eh"), F.col("g").alias("eg"), *[F.col(c).alias(f"near_{c}") for c in firsts])
        hit = marked.filter("near").join(other, ["eh", "eg"])
        hit = hit.select("h", "g", "ord", "near", *[F.col(f"near_{c}").alias(f"src_{c}") for c in firsts])
        marked = marked.filter("NOT near").select("h", "g", "ord", "near", *[f"src_{c}" for c in firsts]).unionByName(hit)
        marked = materialize(marked, lasting=True)
    marked = marked.withColumnRenamed("ord", "first").drop("cnt", "eh", "eg", "src_pos", *([] if sources else ["src_id", "src_t"]))
    # ``z`` is always 0. As a key that ``marked`` is not dealt by, it makes both sides of the join exchanges, which adaptive execution splits where a line is hot.
    zero = F.pmod("g", F.lit(1))
    gone = placed.withColumn("z", zero).join(marked.withColumn("z", zero), ["h", "g", "z"]).filter("near OR ord <> first")
    if not sources:
        return gone.groupBy("id", "t").agg(F.collect_set(F.struct("pos", "near")).alias("gone"))
    by = ["id", "t", "chars", "src_id", "src_t", "src_chars"]
    return gone.groupBy(*by).agg(F.collect_set(F.struct("pos", "n")).alias("gone"))


def _left(gone: str) -> str:
    """SQL of ``text`` without the lines at the positions of the array ``gone``."""
    return f"transform(array(split(text, '\\n')), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), {gone}), i -> ls[i]), '\\n'))[0]"


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(id, n_lines, n_removed, n_near, text): the text without the lines that came before."""
    rows = _rows(docs, id, text)
    with scratch(docs.sparkSession):
        gone = _removed(rows, edits, min_chars, pairs_up_to)
    out = _on_row(rows, gone, "left")
    word = WORD.replace("\\", "\\\\")
    lines = F.expr(f"cast(size(filter(split(text, '\\n'), l -> l rlike '{word}')) AS bigint)")
    count = lambda x: F.expr(f"coalesce(cast(size({x}) AS bigint), 0L)")
    kept = F.expr(f"CASE WHEN size(gone) > 0 THEN {_left('gone.pos')} ELSE text END")
    return out.select(F.col("id").alias(id), lines.alias("n_lines"), count("gone").alias("n_removed"), count("filter(gone, x -> x.near)").alias("n_near"), kept.alias(text))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: str | None = "n_chars", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with their lines removed; ``chars``, if there is such a column, is their new length. Every row stays.

    A document that shares lines of ``COPIED`` of its characters or more with one
    earlier document of like size is a whole copy or near copy by all signs. It
    keeps its text, since near-duplicate detection must judge it by all of it:
    without the lines that it shares, a near copy would be near nothing.
    """
    rows = _rows(docs, id, text)
    with scratch(docs.sparkSession):
        parts = _removed(rows, edits, min_chars, PAIRS_UP_TO, sources=True)
    shared = F.expr("aggregate(gone, 0L, (a, x) -> a + x.n)")
    alike = F.col("src_chars").between(F.col("chars") * LIKE_SIZE, F.col("chars") / LIKE_SIZE) & ~(F.col("id").eqNullSafe(F.col("src_id")) & (F.col("t") == F.col("src_t")))
    parts = parts.withColumn("copy", alike & (shared >= COPIED * F.col("chars")))
    gone = parts.groupBy("id", "t").agg(F.max("copy").alias("copy"), F.flatten(F.collect_list("gone.pos")).alias("gone")).filter("NOT copy").select("id", "t", "gone")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id).alias("id"), F.xxhash64(body).alias("t"), F.col(text).alias("text"))
    d = _on_row(whole, gone, "left").withColumn("left", F.expr(f"CASE WHEN size(gone) > 0 THEN {_left('gone')} ELSE text END"))
    fields = {text: F.col("left").cast(docs.schema[text].dataType)}
    if chars in docs.columns:
        fields[chars] = F.when(F.size("gone") > 0, F.length("left").cast(docs.schema[chars].dataType)).otherwise(F.col(f"row.`{chars}`"))
    return d.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
