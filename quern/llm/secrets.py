"""Secret scans: known shapes and a battery of randomness tests, in Spark expressions only.

Known shapes (assignments of credentials, access keys, long hex strings) are
found by regular expressions. The method adds tokens that look drawn at random:
for each long token an encoding is inferred from its characters, and three
tests ask whether it is uniform over that alphabet: chi-squared on the counts,
the number of runs about the middle of the alphabet, and the serial correlation
of neighbours. A token that passes all three gets a p-value against structured
text (the chance of so few coincidences in a string of its length), and the
tokens reported are those that false-discovery control keeps at ``FDR`` among
all candidates of that encoding in the corpus.

The candidates' p-values meet in a histogram of bounded size, from which the
driver reads one threshold for each encoding. No rows are exchanged; a very
long text is one task's own work, in time about linear in its length.

Positions are code points, ends exclusive. Defined results: a null or empty
text has no spans; repeated rows are scanned each time; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, scratch

# The known shapes. Group ``group`` of a match must have ``least`` characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
SHAPES = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
KINDS = ("assign", "access", "hex", "random")

#: A long token with its base64 padding, if any; a '=' that more of a token follows is none.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Encodings by their alphabet, what a token of it must match, and the chance that two characters of structured text of that form agree. The first that fits counts; the last four take what the others leave.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", 0.12),
    "hex_upper": ("0123456789ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", 0.12),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", 0.065),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[g-z])[0-9a-z]+$", 0.065),
    "base36_upper": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", 0.065),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", 0.05),
    "lower": ("abcdefghijklmnopqrstuvwxyz", r"^[a-z]{2,}$", 0.065),
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^[A-Z]{2,}$", 0.065),
    "letters": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^[A-Za-z]{2,}$", 0.05),
    "decimal": ("0123456789", r"^[0-9]{2,}$", 0.12),
}
#: Tokens cut up by signs that their encoding has not (UUIDs, serial numbers) are tested without the signs, apart from whole ones.
SIGNS, CUT = "+/_-", "_cut"
FAMILIES = [e + cut for cut in ("", CUT) for e in ENCODINGS]
#: No test may be this many standard deviations off.
Z = 3.3
FDR = 0.01
BINS, BIN_WIDTH = 300, 0.1
_BLOCK = 512
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _find(df: DataFrame, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """Adds ``name``: spans (start, end) of the matches that are long enough.

    Starts are running sums of the stretches between matches. They are summed
    in blocks, as growing one long array would take quadratic time.
    """
    p, lengths, base = _quoted(pattern), f"__{name}_l", f"__{name}_b"
    df = df.withColumn(f"__{name}_f", F.expr(f"__t rlike {p}"))
    df = df.withColumn(f"__{name}_m", F.expr(f"CASE WHEN __{name}_f THEN regexp_extract_all(__t, {p}, 0) END"))
    df = df.withColumn(f"__{name}_g", F.expr(f"CASE WHEN __{name}_f THEN split(__t, {p}, -1) END"))
    long = f"__{name}_m" if not group else f"CASE WHEN __{name}_f THEN regexp_extract_all(__t, {p}, {group}) END"
    df = df.withColumn(f"__{name}_k", F.expr(long))
    df = df.withColumn(
        lengths,
        F.expr(
            f"CASE WHEN __{name}_f THEN transform(sequence(0, size(__{name}_m) - 1), i -> struct(cast(length(__{name}_g[i]) AS bigint) AS g, cast(length(__{name}_m[i]) AS bigint) AS m, length(__{name}_k[i]) >= {least} AS ok)) END"
        ),
    )
    df = df.withColumn(f"__{name}_s", F.expr(f"CASE WHEN __{name}_f THEN transform(sequence(0, (size({lengths}) - 1) div {_BLOCK}), b -> slice({lengths}, cast(b * {_BLOCK} + 1 AS int), {_BLOCK})) END"))
    df = df.withColumn(
        base,
        F.expr(
            f"aggregate(transform(__{name}_s, x -> aggregate(x, 0L, (a, y) -> a + y.g + y.m)), named_struct('s', 0L, 'a', cast(array() AS array<bigint>)), (s, n) -> named_struct('s', s.s + n, 'a', concat(s.a, array(s.s))), s -> s.a)"
        ),
    )
    inner = (
        f"aggregate(x, named_struct('p', {base}[b], 'a', cast(array() AS {_SPANS})), (s, y) -> named_struct('p', s.p + y.g + y.m, 'a', "
        f"CASE WHEN y.ok THEN concat(s.a, array(named_struct('start', s.p + y.g, 'end', s.p + y.g + y.m))) ELSE s.a END), s -> s.a)"
    )
    df = df.withColumn(name, F.expr(f"coalesce(CASE WHEN size({base}) > 0 THEN flatten(transform(__{name}_s, (x, b) -> {inner})) END, cast(array() AS {_SPANS}))"))
    return df.drop(*(f"__{name}_{k}" for k in "fmgklsb"))


def _scored(token: str) -> str:
    """SQL of a struct (enc, bin, random) for one token; null where less than two characters are left without signs."""
    base64 = _quoted(ENCODINGS["base64"][1])
    whole = f"translate({token}, '-_', '+/')"
    out = "CASE"
    for name, (alphabet, shape, agree) in ENCODINGS.items():
        k = len(alphabet)
        t = "w.v"
        counts = f"transform(split('{alphabet}', ''), a -> length(t.v) - length(replace(t.v, a, '')))"
        places = f"transform(split(t.v, ''), c -> cast(instr('{alphabet}', c) AS double))"
        chi = f"(({k} / s.n) * s.o - s.n - {k - 1}) / {math.sqrt(2 * (k - 1))}"
        high = "size(filter(s.x, v -> v > {h}))".format(h=k / 2)
        runs = f"(1 + size(filter(sequence(1, cast(s.n AS int) - 1), i -> (s.x[i] > {k / 2}) <> (s.x[i - 1] > {k / 2}))))"
        mean = "(aggregate(s.x, 0D, (a, v) -> a + v) / s.n)"
        # Nested one-element transforms name intermediate values, so that none is computed twice.
        level1 = f"transform(array(named_struct('v', {t})), t -> named_struct('n', cast(length(t.v) AS double), 'o', aggregate({counts}, 0D, (a, c) -> a + cast(c AS double) * c), 'x', {places}))"
        level2 = (
            f"transform({level1}, s -> named_struct('n', s.n, 'c', (s.o - s.n) / 2, 'chi', {chi}, 'n1', cast({high} AS double), 'r', {runs}, 'x', s.x, 'm', {mean}))"
        )
        mu = "(2 * u.n1 * (u.n - u.n1) / u.n + 1)"
        zr = f"CASE WHEN {mu} > 2 THEN (u.r - {mu}) / sqrt(({mu} - 1) * ({mu} - 2) / (u.n - 1)) ELSE 9 END"
        var = "aggregate(u.x, 0D, (a, v) -> a + (v - u.m) * (v - u.m))"
        cov = "aggregate(sequence(1, cast(u.n AS int) - 1), 0D, (a, i) -> a + (u.x[i] - u.m) * (u.x[i - 1] - u.m))"
        zs = f"CASE WHEN {var} > 0 THEN sqrt(u.n) * ({cov}) / ({var}) ELSE 9 END"
        expected = f"({agree} * u.n * (u.n - 1) / 2)"
        z = f"((u.c + 0.5 - {expected}) / sqrt(1.5 * {expected}))"
        # Minus the decimal logarithm of the normal tail, by its usual logistic approximation.
        tail = f"(ln(1 + exp(least(700D, -(1.5976 * greatest({z}, -14D) + 0.07056 * pow(greatest({z}, -14D), 3))))) / {math.log(10)})"
        level3 = f"transform({level2}, u -> named_struct('enc', concat('{name}', w.cut), 'bin', cast(least({BINS}, floor({tail} / {BIN_WIDTH})) AS int), 'random', abs(u.chi) < {Z} AND abs({zr}) < {Z} AND abs({zs}) < {Z}))"
        out += f" WHEN w.v rlike {_quoted(shape)} THEN element_at({level3}, 1)"
    bare = f"translate({token}, '{SIGNS}', '')"
    keep = f"({whole} rlike {base64})"
    named = f"CASE WHEN {keep} THEN named_struct('v', {whole}, 'cut', '') ELSE named_struct('v', {bare}, 'cut', CASE WHEN {token} = {bare} THEN '' ELSE '{CUT}' END) END"
    return f"element_at(transform(array({named}), w -> {out} END), 1)"


def _scanned(docs: DataFrame, row: Column, text: str) -> DataFrame:
    df = docs.select(row.alias("__row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    for name, (pattern, group, least) in SHAPES.items():
        df = _find(df, name, pattern, group, least)
    df = _find(df, "token", CANDIDATE, 0, 20)
    scored = f"transform(token, s -> struct(s.start AS start, s.end AS end, {_scored("rtrim('=', substring(__t, cast(s.start + 1 AS int), cast(s.end - s.start AS int)))")} AS v))"
    df = df.withColumn("tokens", F.expr(f"CASE WHEN size(token) > 0 THEN filter({scored}, x -> x.v IS NOT NULL) END"))
    return df.select("__row", "assign", "access", "hex", "tokens")


def _thresholds(scanned: DataFrame) -> dict[str, int]:
    """The lowest bin to report for each encoding, by the step-up rule over the histogram."""
    tokens = scanned.filter("size(tokens) > 0").select(F.explode("tokens.v").alias("v"))
    counts = tokens.groupBy("v.enc", "v.bin").agg(F.count("*").alias("n")).collect()
    out = {}
    for enc in FAMILIES:
        own = {r.bin: r.n for r in counts if r.enc == enc}
        total, seen, out[enc] = sum(own.values()), 0, BINS + 1
        for b in sorted(own, reverse=True):
            seen += own[b]
            if 10 ** (-b * BIN_WIDTH) <= FDR * seen / total:
                out[enc] = b
    return out


def _judged(docs: DataFrame, row: Column, text: str) -> DataFrame:
    """(__row, assign, access, hex, random)."""
    with scratch(docs.sparkSession):
        scanned = materialize(_scanned(docs, row, text), lasting=True)
    least = _thresholds(scanned)
    high = "CASE x.v.enc " + " ".join(f"WHEN '{e}' THEN {b}" for e, b in least.items()) + " END"
    random = f"coalesce(transform(filter(tokens, x -> x.v.random AND x.v.bin >= {high}), x -> struct(x.start AS start, x.end AS end)), cast(array() AS {_SPANS}))"
    return scanned.select("__row", "assign", "access", "hex", F.expr(random).alias("random"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, assign, access, hex, random) for each row: arrays of spans (start, end)."""
    return _judged(docs, F.col(id), text).withColumnRenamed("__row", id)


def spelled(kinds: tuple[str, ...] = KINDS) -> str:
    """SQL of all spans of these columns as ``kind:start:end``, by start and then kind, comma-joined."""
    parts = ", ".join(f"transform({k}, s -> struct(s.start AS start, {i} AS rank, s.end AS end))" for i, k in enumerate(kinds))
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return f"array_join(transform(array_sort(concat({parts})), s -> concat_ws(':', {names}[s.rank], s.start, s.end)), ',')"


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one. Each row is judged by its own text."""
    found = _judged(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text)
    spans = found.select("__row", F.expr("array_sort(concat(assign, access, hex, random))").alias("spans"), F.col(f"__row.`{text}`").alias("t"))
    step = f"named_struct('at', greatest(a.at, s.end), 'out', CASE WHEN s.start >= a.at THEN concat(a.out, substring(t, cast(a.at + 1 AS int), cast(s.start - a.at AS int)), {_quoted(mark)}) ELSE a.out END)"
    body = f"aggregate(spans, named_struct('at', 0L, 'out', ''), (a, s) -> {step}, a -> concat(a.out, substring(t, cast(a.at + 1 AS int))))"
    left = F.expr(f"CASE WHEN size(spans) > 0 THEN {body} ELSE t END")
    return spans.select(*[(left if c == text else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
