"""Personal data: fixed patterns, and terms that reveal them by corpus co-occurrence. DataFrame operations only.

Base spans are the leftmost non-overlapping matches of four patterns; those that fail their test are dropped. The
patterns are written without backtracking over a whole run and with group loops that need no stack, so very long runs
cost linear time; they match what the plain forms below match:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), each part at most 255
    card   [0-9]([\\x20-]?[0-9])+, 13 to 19 digits that pass the Luhn test
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

Positions come from the lengths of matches and of the pieces between them, in code points, as prefix sums in two
levels (so that a text with very many matches stays near linear).

Information-theoretic sanitisation: the value of a base span is a protected entity c. A term t is a run of at least
four letters, lower-cased; it is near c where it stands within CONTEXT code points of a span of c. With df counted
over texts, t reveals c if PMI(c; t) >= ALPHA * IC(c), where IC(c) = -log(df(c) / N) is what c is worth and PMI(c; t)
= log(N * df(c near t) / (df(c) * df(t))) is how much of that t gives away; that is, if
df(c near t) / df(t) >= (df(c) / N) ** (1 - ALPHA). Estimates need at least MIN_TEXTS different texts with c near t.
All occurrences of such a t in a text that has it near c become spans of kind `term`; spans that touch a base span are
left out. sanitise() replaces base spans by their kind and generalises revealing terms.

Counts are over the different texts of all documents (N, too); copies of a text add nothing. Pairs (entity, term) exist for terms near an entity only, so they grow with the number
of base spans, not with squares of groups; hot entities and hot terms are aggregated before they are shuffled.

Defined results: a null text is an empty one; equal texts get equal spans; rows are kept one for one whatever doc_id
holds (null and repeated ids too); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_keys

KINDS = ("email", "ip", "card", "phone")
_E = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_E}])|\G)[{_E}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match that passes; checked first, since most texts have none.
FIRST = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
}
CONTEXT = 80
ALPHA = 0.8
MIN_TEXTS = 2
BROADCAST_ROWS = 500_000
_BLOCK = 256
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


PASSES = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), x -> cast(x as double) <= 255)",
    "card": f"length({_digits('s.value')}) between 13 and 19 and luhn_check({_digits('s.value')})",
    "phone": f"length({_digits('s.value')}) between 9 and 15",
}


def with_spans(rows: DataFrame, text: str, found: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with a column of all matches (start, end, value) for each name: (pattern, whether to look at all)."""
    for name, (pattern, look) in found.items():
        rows = rows.withColumn(f"_m_{name}", F.when(look, F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")))
        rows = rows.withColumn(f"_p_{name}", F.when(F.size(f"_m_{name}") > 0, F.transform(F.split(F.col(text), pattern), F.length)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("*", *[F.expr(f"zip_with(_m_{n}, slice(_p_{n}, 1, size(_m_{n})), (m, p) -> cast(length(m) + p as bigint))").alias(f"_l_{n}") for n in found])
    block = "aggregate(slice({l}, b * {k} + 1, {k}), 0L, (s, x) -> s + x)"
    rows = rows.select("*", *[F.expr(f"transform(sequence(0, size(_l_{n}) div {_BLOCK}), b -> {block.format(l=f'_l_{n}', k=_BLOCK)})").alias(f"_s_{n}") for n in found])
    rows = rows.select("*", *[F.expr(f"transform(_s_{n}, (x, b) -> aggregate(slice(_s_{n}, 1, b), 0L, (s, y) -> s + y))").alias(f"_b_{n}") for n in found])
    before = "_b_{n}[i div {k}] + aggregate(slice(_l_{n}, (i div {k}) * {k} + 1, i % {k}), 0L, (s, x) -> s + x) + _p_{n}[i]"
    rows = rows.select("*", *[F.expr(f"transform(_m_{n}, (m, i) -> named_struct('start', {before.format(n=n, k=_BLOCK)}, 'value', m))").alias(f"_a_{n}") for n in found])
    rows = rows.select("*", *[F.expr(f"transform(_a_{n}, a -> named_struct('start', cast(a.start as bigint), 'end', cast(a.start + length(a.value) as bigint), 'value', a.value))").alias(n) for n in found])
    return rows.drop(*(f"_{x}_{n}" for x in "mplsba" for n in found))


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with columns email, ip, card, phone: the spans that pass."""
    rows = with_spans(rows, text, {k: (PATTERNS[k], FIRST[k](F.col(text))) for k in KINDS})
    return rows.withColumns({k: F.expr(f"filter({k}, s -> {PASSES[k]})") for k in KINDS if PASSES[k] != "true"})


def _near_sql(text: str, span: str) -> str:
    """SQL: lower-cased letter runs of four or more on either side of a span; runs that the window cuts don't count."""
    left = f"substring({text}, cast(greatest(1L, {span}.start - {CONTEXT} + 1) as int), cast(least({span}.start, {CONTEXT}L) as int))"
    left = f"if({span}.start > {CONTEXT}, regexp_replace({left}, '^\\\\p{{L}}+', ''), {left})"
    right = f"substring({text}, cast({span}.end + 1 as int), {CONTEXT})"
    right = f"if(length({text}) > {span}.end + {CONTEXT}, regexp_replace({right}, '\\\\p{{L}}+$', ''), {right})"
    return f"array_distinct(filter(split(lower(concat({left}, ' ', {right})), '[^\\\\p{{L}}]+'), w -> length(w) >= 4))"


def terms(text: str = "text") -> Column:
    """Hashes of the different terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: F.length(w) >= 4), lambda w: F.xxhash64(w)))


def find(docs: DataFrame, alpha: float = ALPHA, min_texts: int = MIN_TEXTS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_key, email, ip, card, phone, term): spans of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.struct(*text_keys(F.col("text"))))
    tagged = base_spans(rows)
    every = F.concat(*KINDS)
    near = f"named_struct('entity', xxhash64(s.value), 'terms', transform({_near_sql('text', 's')}, w -> xxhash64(w)))"
    tagged = tagged.withColumn("_e", every).withColumn("pairs", F.expr(f"transform(_e, s -> {near})"))
    tagged = materialise(tagged.select("doc_id", "text_key", *KINDS, "pairs"), "base-spans")
    total = tagged.select("text_key").distinct().count()

    occurs = tagged.where(F.size("pairs") > 0).select("text_key", F.explode("pairs").alias("p")).select("text_key", "p.entity", "p.terms")
    of_entity = occurs.select("text_key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_c")).where(F.col("df_c") >= min_texts)
    near = materialise(occurs.select("text_key", "entity", F.explode("terms").alias("term")).distinct(), "near")
    joint = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_ct")).where(F.col("df_ct") >= min_texts)
    joint = materialise(joint.join(of_entity, "entity"), "joint")
    wanted = materialise(joint.select("term").distinct(), "terms")
    n = wanted.count()
    # Copies of a text count once, as in df_c and df_ct.
    seen = rows.select("text_key", terms().alias("terms")).groupBy("text_key").agg(F.any_value("terms").alias("terms")).select(F.explode("terms").alias("term"))
    of_term = seen.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    share = F.pow(F.col("df_c") / F.lit(float(max(total, 1))), F.lit(1.0 - alpha))
    reveals = joint.join(of_term, "term").where(F.col("df_ct") / F.col("df_t") >= share).select("entity", "term")
    told = near.join(reveals, ["entity", "term"]).groupBy("text_key").agg(F.collect_set("term").alias("told"))
    told = materialise(told.withColumnRenamed("text_key", "_key"), "told")

    # Positions of revealing terms, once for each text that has them.
    texts = rows.join(told, F.col("text_key") == F.col("_key")).select("text_key", "text", "told").dropDuplicates(["text_key"])
    texts = with_spans(texts, "text", {"term": (r"\p{L}+", F.lit(True))})
    texts = texts.select(F.col("text_key").alias("_key"), F.expr("filter(term, s -> array_contains(told, xxhash64(lower(s.value))))").alias("term"))
    out = tagged.join(texts, F.col("text_key") == F.col("_key"), "left").withColumn("term", F.coalesce("term", F.array().cast(SPAN)))
    apart = F.expr("filter(term, t -> not exists(concat(email, ip, card, phone), b -> b.start < t.end and t.start < b.end))")
    return out.withColumn("term", apart).select("doc_id", "text_key", *KINDS, "term")


def digest(found: DataFrame) -> DataFrame:
    """The spans of find() as counts, strings and a checksum."""
    text = {k: F.expr(f"transform({k}, s -> concat('{k}:', s.start, ':', s.end))") for k in (*KINDS, "term")}
    base = F.array_join(F.concat(*(text[k] for k in KINDS)), ",")
    spans = F.array_join(F.concat(*text.values()), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.size("term").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs with text rewritten: base spans become [EMAIL], [IP], [CARD], [PHONE], revealing terms [TERM].

    Where spans overlap, the one that starts first (then by kind as listed) is replaced and the others fall away.
    """
    found = find(docs) if found is None else found
    tag = "transform({k}, s -> named_struct('start', s.start, 'kind', {n}, 'end', s.end, 'tag', '[{t}]'))"
    tags = F.concat(*[F.expr(tag.format(k=k, n=n, t=k.upper())) for n, k in enumerate((*KINDS, "term"))])
    spans = found.select(F.col("text_key").alias("__sm_key"), F.array_sort(tags).alias("__sm_s")).dropDuplicates(["__sm_key"])
    spans = spans.withColumn("__sm_s", F.expr("filter(__sm_s, (x, i) -> not exists(slice(__sm_s, 1, i), y -> y.end > x.start))"))
    text = F.coalesce("text", F.lit(""))
    out = docs.join(spans, F.struct(*text_keys(text)) == F.col("__sm_key"), "left")
    pieces = "transform(__sm_s, (x, i) -> concat(substring(text, cast(if(i = 0, 0L, __sm_s[i - 1].end) as int) + 1, cast(x.start - if(i = 0, 0L, __sm_s[i - 1].end) as int)), x.tag))"
    whole = F.expr(f"if(__sm_s is null or size(__sm_s) = 0, text, concat(array_join({pieces}, ''), substring(text, cast(__sm_s[size(__sm_s) - 1].end as int) + 1)))")
    return out.withColumn("text", whole).select(*docs.columns)
