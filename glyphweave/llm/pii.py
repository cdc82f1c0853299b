"""Personal data by bootstrapped contextual extraction. DataFrame and SQL functions only.

Base patterns give the seeds: e-mail addresses, IP addresses, card and phone numbers; long hexadecimal
words that something is set to seed a fifth kind, secrets. What stands around seeds are lexical patterns:
one or two words before, the word after, one before and one after, and the shapes of two words before
(letters as a, digits as 9). Patterns and the values met in them form a bipartite graph that is scored in
rounds until nothing changes: a pattern is trusted for a kind by the share of its distinct values that are
of the kind, where unknown values that look like it count little; a value that no seed pattern knows is believed by noisy-or over the trusted patterns it stands
in, and then counts as an instance in the next round. Mentions of believed values, and of seeds of secrets,
in trusted patterns become spans. Base spans always stay. Beliefs only ever grow and trust has three
decimals, so the rounds end.

Texts are read once; all that follows works on mentions and on distinct (pattern, value) edges. A
pattern or value that a third of all edges share is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, stage, table, text_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive runs and the looks behind change no match: they keep long runs linear
# where every start within a run would be tried in vain.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "regexp_replace({m}, '[^0-9]', '')"
TESTS = {
    "email": "true",
    "ip": r"{m} rlike r'^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})){{3}}$'",
    "card": f"length({DIGITS}) between 16 and 19 and luhn_check({DIGITS})",
    "phone": f"length({DIGITS}) between 8 and 15",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": "instr(t, '@') > 0", "ip": "t rlike '[0-9][.]'", "card": "t rlike '[0-9][ 0-9-]'", "phone": "t rlike '[+][0-9]'"}

#: Runs of up to four words with a digit or an at sign, joined by single spaces. Where no phone or card number is in a run, its words are candidates too.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+){0,3}+"
#: The kind that only the method finds, after the base kinds, and its seeds: a long hexadecimal word after an equals sign or a colon.
SECRET = "secret"
FOUND_KINDS = (*KINDS, SECRET)
SECRET_SEED = r"^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}$"
#: What an unknown value must look like to be believed as a kind.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^([0-9]{1,3}([.][0-9]{1,3}){2,3}|[0-9a-f]{1,4}(:[0-9a-f]{0,4}){2,7})$",
    "card": r"^[0-9][0-9 -]{10,22}[0-9]$",
    "phone": r"^[+(]?[0-9][0-9 ().-]{3,18}[0-9]$",
    SECRET: r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])[0-9a-z+/_=-]{12,}$",
}
#: A pattern is trusted from this share of its distinct values, and this many of them. Unknown values that look like the kind count for this much.
TRUST = 0.7
NEUTRAL = 0.25
SUPPORT = 6
BELIEF = 0.7
#: Words and values beyond these lengths stand in the graph by their digest.
LONG_WORD, LONG_VALUE = 64, 128
#: Prefix sums go in blocks of this size, so that a text with many matches stays near linear.
BLOCK = 256


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value, which is computed once however often the name stands."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _located(pattern: str, around: bool = False) -> str:
    """SQL: matches m of a pattern in t and their start, and if asked for the pieces of text b and c before and after them."""
    found = f"regexp_extract_all(t, r'{pattern}', 0)"
    pieces = f"split(t, r'{pattern}', -1)"
    items = "zip_with(w.f, w.p, (m, p) -> named_struct('m', m, 'p', p))"
    items = f"zip_with({items}, slice(w.p, 2, size(w.f)), (x, q) -> named_struct('m', x.m, 'p', x.p, 'q', q))"
    if around:  # the matches beside one belong to its context
        items = f"zip_with({items}, concat(array(''), slice(w.f, 1, size(w.f) - 1)), (x, y) -> named_struct('m', x.m, 'p', x.p, 'q', x.q, 'f', y))"
        items = f"zip_with({items}, concat(slice(w.f, 2, size(w.f) - 1), array('')), (x, y) -> named_struct('m', x.m, 'p', x.p, 'b', concat(x.f, x.p), 'c', concat(x.q, y)))"
        kept, names = "'m', x.m, 'b', x.b, 'c', x.c", "m: string, b: string, c: string"
    else:
        kept, names = "'m', x.m", "m: string"
    empty = f"cast(array() as array<struct<{names}, at: bigint>>)"
    step = f"named_struct('at', a.at + length(x.p) + length(x.m), 'out', concat(a.out, array(named_struct({kept}, 'at', a.at + length(x.p)))))"
    inner = f"aggregate(block, named_struct('at', acc.at, 'out', {empty}), (a, x) -> {step})"
    outer = _let("i", inner, "named_struct('at', i.at, 'out', concat(acc.out, i.out))")
    blocks = f"transform(sequence(0, (n - 1) div {BLOCK}), b -> slice(v, b * {BLOCK} + 1, least({BLOCK}, n - b * {BLOCK})))"
    walked = f"aggregate({blocks}, named_struct('at', 0L, 'out', {empty}), (acc, block) -> {outer}).out"
    return _let("w", f"named_struct('f', {found}, 'p', {pieces})", _let("v", items, _let("n", "size(w.f)", walked)))


def _spans(kind: str) -> str:
    """SQL: the spans of a base kind in t."""
    none = "cast(array() as array<struct<kind: int, s: bigint, e: bigint>>)"
    test = TESTS[kind].format(m="x.m")
    spans = f"transform(filter({_located(PATTERNS[kind])}, x -> {test}), x -> named_struct('kind', {KINDS.index(kind)}, 's', x.at, 'e', x.at + length(x.m)))"
    return f"CASE WHEN {HINTS[kind]} AND t rlike r'{PATTERNS[kind]}' THEN {spans} ELSE {none} END"


def _known(m: str, kinds: tuple[str, ...]) -> str:
    """SQL: the number of the first base kind that a piece of text holds a match of, or null."""
    tests = " ".join(f"WHEN exists(regexp_extract_all({m}, r'{PATTERNS[k]}', 0), y -> {TESTS[k].format(m='y')}) THEN {KINDS.index(k)}" for k in kinds)
    return f"CASE {tests} END"


def _short(word: str, limit: int) -> str:
    return f"CASE WHEN length({word}) > {limit} THEN sha2({word}, 256) ELSE {word} END"


def _candidate(at: str, m: str, before: str, after: str, kind: str) -> str:
    """SQL: the candidate m between two pieces of text, with its lexical patterns."""
    core = r"regexp_replace(regexp_replace(g.m, r'^[^0-9A-Za-z+(]++', ''), r'(?<![^0-9A-Za-z)])[^0-9A-Za-z)]++$', '')"
    lead = r"length(g.m) - length(regexp_replace(g.m, r'^[^0-9A-Za-z+(]++', ''))"
    word = lambda text, pattern, turned: f"lower({'reverse' if turned else ''}(regexp_extract({text}, r'{pattern}', 1)))"
    words = f"""named_struct('one', {word('g.b', r'^\s*+(\S++)', True)}, 'two', {word('g.b', r'^\s*+\S++\s++(\S++)', True)}, 'next', {word('g.c', r'^\s*+(\S++)', False)})"""
    cut = ", ".join(f"'{k}', {_short(f'z.{k}', LONG_WORD)}" for k in ("one", "two", "next"))
    shape = r"regexp_replace(regexp_replace(concat(h.two, ' ', h.one), '[0-9]+', '9'), '\\p{L}+', 'a')"
    patterns = f"""filter(array(
        CASE WHEN h.one <> '' THEN concat('b1 ', h.one) END,
        CASE WHEN h.two <> '' THEN concat('b2 ', h.two, ' ', h.one) END,
        CASE WHEN h.two <> '' AND {shape} <> 'a a' THEN concat('s ', {shape}) END,
        CASE WHEN h.one <> '' AND h.next <> '' THEN concat('m ', h.one, ' _ ', h.next) END,
        CASE WHEN h.next <> '' THEN concat('a1 ', h.next) END), p -> p IS NOT NULL)"""
    fits = " + ".join(f"CASE WHEN lower(g.core) rlike r'{SHAPES[k]}' THEN {1 << i} ELSE 0 END" for i, k in enumerate(FOUND_KINDS))
    seed = rf"CASE WHEN lower(g.core) rlike r'{SECRET_SEED}' AND h.one rlike '[=:]$' THEN {len(KINDS)} END"
    made = f"""named_struct('s', g.at + g.lead, 'e', g.at + g.lead + length(g.core), 'value', {_short('lower(g.core)', LONG_VALUE)},
        'kind', coalesce(g.kind, {seed}), 'fits', {fits}, 'patterns', {patterns})"""
    given = f"named_struct('at', {at}, 'm', {m}, 'b', reverse({before}), 'c', {after}, 'kind', {kind})"
    stripped = f"named_struct('at', g.at, 'b', g.b, 'c', g.c, 'kind', g.kind, 'lead', {lead}, 'core', {core})"
    return _let("g", given, _let("g", stripped, _let("z", words, _let("h", f"named_struct({cut})", made))))


def _candidates() -> str:
    """SQL: candidate values in t, with the kind a seed pattern gives them, the shapes they fit and their lexical patterns."""
    none = "cast(array() as array<struct<s: bigint, e: bigint, value: string, kind: int, fits: int, patterns: array<string>>>)"
    whole = lambda kind: _candidate("x.at", "x.m", "x.b", "x.c", kind)
    # A word of a run begins where the words before it and a space after each end.
    begin = "aggregate(slice(v, 1, i), 0, (a, y) -> a + length(y) + 1)"
    word = _let("o", begin, _candidate("x.at + o", "v[i]", "concat(x.b, substring(x.m, 1, o))", "concat(substring(x.m, o + length(v[i]) + 1), x.c)", _known("v[i]", KINDS)))
    split = _let("v", "split(x.m, ' ')", f"concat(array({whole('cast(null as int)')}), transform(sequence(0, size(v) - 1), i -> {word}))")
    many = _let("k", _known("x.m", ("card", "phone")), f"CASE WHEN k IS NULL THEN {split} ELSE array({whole('k')}) END")
    each = f"CASE WHEN instr(x.m, ' ') > 0 THEN {many} ELSE array({whole(_known('x.m', KINDS))}) END"
    made = f"filter(flatten(transform({_located(CANDIDATE, True)}, x -> {each})), r -> r.e > r.s AND (r.kind IS NOT NULL OR r.fits <> 0 OR instr(r.value, ' ') = 0))"
    return f"CASE WHEN t rlike '[0-9@]' AND t rlike r'{CANDIDATE}' THEN {made} ELSE {none} END"


def read_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The one pass over texts: doc_id, seq, spans of base kinds, candidates."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    spans = ", ".join(_spans(k) for k in KINDS)
    return stage(rows.select("doc_id", F.monotonically_increasing_id().alias("seq"), F.expr(f"concat({spans})").alias("base"), F.expr(_candidates()).alias("found")), "pii")


def _mark(scores: DataFrame) -> tuple:
    return tuple(scores.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("pattern", "kind", "trust"))).first())


def score_graph(edges: DataFrame) -> DataFrame:
    """edges: pattern, value, kind (null if no seed pattern knows the value), fits, n (mentions). Accepted: pattern, value, kind, n.

    Every round joins patterns to values by salted shuffles of distinct edges; sums are combined before them.
    """
    total = edges.count()
    values = stage(edges.groupBy("value").agg(F.max("kind").alias("known"), F.bit_or("fits").alias("shapes"), F.count(F.lit(1)).alias("value_edges")), "pii-values")
    patterns = stage(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("edges")).filter(F.col("edges") >= SUPPORT), "pii-patterns")
    met = salted_join(edges.select("pattern", "value", "n"), patterns, ["pattern"], "edges", total, F.xxhash64("value"))
    met = stage(salted_join(met, values, ["value"], "value_edges", total, F.xxhash64("pattern")), "pii-met")
    seeds = met.filter("known IS NOT NULL").groupBy("pattern", F.col("known").alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("mass"))
    unknown = met.filter("known IS NULL AND shapes <> 0").select("pattern", "value", "n", "shapes", "value_edges")
    fits = F.col("shapes").bitwiseAND(F.expr("shiftleft(1, kind)")) != 0
    likely = F.array(*[F.sum(F.expr(f"shiftright(shapes, {i}) & 1")) for i in range(len(FOUND_KINDS))]).alias("open")
    rooms = stage(patterns.join(unknown.groupBy("pattern").agg(likely), "pattern", "left"), "pii-rooms")
    believed = None
    mark = None
    while True:
        mass = seeds
        if believed is not None:
            more = salted_join(unknown.drop("value_edges"), believed, ["value"], "value_edges", total, F.xxhash64("pattern")).groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"))
            mass = seeds.union(more).groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"))
        against = F.col("edges") - (1 - NEUTRAL) * F.expr("coalesce(open[kind], 0)")
        trust = F.least(F.floor(F.col("mass") / against * 1000 + 1e-6) / 1000, F.lit(1.0))
        trusted = stage(mass.join(rooms, "pattern").withColumn("trust", trust).filter((F.col("trust") >= TRUST) & (F.col("mass") >= SUPPORT - 1e-6)).select("pattern", "kind", "trust", "edges"), "pii-trusted")
        before, mark = mark, _mark(trusted)
        if mark == before:
            break
        doubt = F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.99)))))
        held = salted_join(unknown, trusted, ["pattern"], "edges", total, F.xxhash64("value")).filter(fits)
        believed = stage(held.groupBy("value", "kind").agg((1 - doubt).alias("belief"), F.max("value_edges").alias("value_edges")).filter(F.col("belief") >= BELIEF), "pii-believed")
    held = salted_join(met.select("pattern", "value", "n", "known", "value_edges"), trusted, ["pattern"], "edges", total, F.xxhash64("value"))
    seeded = held.filter(F.col("kind") == len(KINDS)).filter(F.col("known") == len(KINDS)).select("pattern", "value", "kind", "n")
    fresh = held.filter("known IS NULL").select("pattern", "value", "kind", "n").withColumnRenamed("kind", "of")
    fresh = salted_join(fresh, believed, ["value"], "value_edges", total, F.xxhash64("pattern")).filter("kind = of").select("pattern", "value", "kind", "n")
    return seeded.union(fresh).distinct()


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_secret, n_spans.

    Spans are kind:start:end in code points, end exclusive, by kind and then start; base_sha256 is of
    the base spans, spans has those and the n_found discovered ones, n_secret of which are secrets, n_spans in all. Null
    text counts as empty; a text without spans has the digest of the empty string. Ids may be null or
    repeated: each row is judged on its own text. An empty table gives no rows. Other columns are ignored.
    """
    rows = read_texts(docs, id_col, text_col)
    mentions = rows.select("seq", F.explode("found").alias("f")).select("seq", "f.s", "f.e", "f.value", "f.kind", "f.fits", F.explode("f.patterns").alias("pattern"))
    edges = stage(mentions.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.bit_or("fits").alias("fits"), F.count(F.lit(1)).alias("n")), "pii-edges")
    accepted = stage(score_graph(edges), "pii-accepted")
    fresh = mentions.filter(f"kind IS NULL OR kind = {len(KINDS)}").drop("kind", "fits")
    fresh = salted_join(fresh, accepted, ["pattern", "value"], "n", fresh.count(), F.xxhash64("seq", "s")).select("seq", "kind", "s", "e").distinct()
    more = fresh.groupBy("seq").agg(F.collect_list(F.struct("kind", "s", "e")).alias("more"))
    all_spans = rows.drop("found").join(more, "seq", "left").withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))))
    joined = lambda c: F.expr(f"array_join(transform({c}, x -> concat_ws(':', array({', '.join(repr(k) for k in FOUND_KINDS)})[x.kind], x.s, x.e)), ',')")
    count = lambda c, i: F.expr(f"cast(size(filter({c}, x -> x.kind = {i})) as bigint)")
    counts = [count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return all_spans.select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_found"), count("spans", len(KINDS)).alias("n_secret"), F.size("spans").cast("long").alias("n_spans")
    )


def op1_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
