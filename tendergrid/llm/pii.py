"""Personal data: labelers vote on spans, EM weighs them, a classifier decides. DataFrame functions only.

Candidates are e-mail addresses, IP addresses, payment cards and phone numbers
as strict patterns find them, plus looser ones: matches that fail their check,
phone numbers without a plus sign, addresses with a written-out "at". Six
labelers (pattern, validity, gazetteer, context for, context against,
neighbouring characters) vote 1, 0 or -1 on each candidate. EM (two latent
classes, labelers independent given the class) estimates their reliabilities
from the counts of vote patterns, and a logistic span classifier is trained on
the posteriors. Vote and feature patterns are counted before the shuffle and
number at most 4 * 3^6 and 2^11, so both fits run inside one SQL expression over one
bounded row, whatever the size of the corpus.

Spans that pass the strict rule always stay; the classifier adds others that
overlap none of them, nor one that it added before by start. Null text counts as empty, empty text has no spans,
repeated rows each get their result, an empty table gives an empty result and
a model of zeros. Only the text column (and the columns asked to be kept) is
read, so extra columns never clash.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendergrid.llm import common

KINDS = ["email", "ip", "card", "phone"]
EM_ROUNDS = 25
FIT_ROUNDS = 150
STEP = 1.0
THRESHOLD = 0.8
CONTEXT_CHARS = 32
# What is known beforehand about the validity check, as shares of its votes -1, 0, 1
# in each class, weighing as much as this many times all candidates. Without it EM
# may find two other groups than personal data and the rest.
PRIOR_SHARE = 10.0
VALID_IF_PERSONAL = "array(0.01D, 0.01D, 0.98D)"
VALID_IF_NOT = "array(0.90D, 0.05D, 0.05D)"

# Fixed patterns of the base rules. Possessive repeats and the look-behind
# leave the matches as they are; they keep the matcher linear and off the stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser shapes that only labelers can confirm.
WRITTEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"
PLAIN_PHONE = r"(?<![0-9+.A-Za-z-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.]?[0-9])"

# Gazetteers: ends of addresses, first digits of card issuers, calling codes.
DOMAIN_ENDS = ["com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "co", "mx", "ch", "at"]
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
CALLING = "^[+](1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-8])"
WORDS_FOR = "e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|credit|address|ip|server|host|kontakt|correo"
WORDS_AGAINST = "version|release|isbn|order|invoice|sha|hash|token|build|serial|page|section|figure"


def _positions(text: str, pattern: str, kind: str, strict: bool, least: int = 1) -> str:
    """SQL: array of {kind, strict, value, start, end} of matches of at least so many characters; code points, end exclusive."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""
    transform(array(struct(split({text}, '{quoted}', -1) AS gaps, regexp_extract_all({text}, '{quoted}', 0) AS hits)), m ->
      aggregate(sequence(0, greatest(size(m.hits), 1) - 1), named_struct('at', 0, 'out', cast(array() AS
        array<struct<kind:string,strict:boolean,value:string,start:int,end:int>>)), (a, i) -> IF(size(m.hits) = 0, a, named_struct(
          'at', a.at + length(get(m.gaps, i)) + length(get(m.hits, i)),
          'out', IF(length(get(m.hits, i)) < {least}, a.out, concat(a.out, array(named_struct('kind', '{kind}',
             'strict', {str(strict).lower()}, 'value', get(m.hits, i), 'start', a.at + length(get(m.gaps, i)),
             'end', a.at + length(get(m.gaps, i)) + length(get(m.hits, i))))))))).out)[0]"""


_NONE = "cast(array() AS array<struct<kind:string,strict:boolean,value:string,start:int,end:int>>)"
_DIGITS = "regexp_replace(c.value, '[^0-9]', '')"
_LUHN = f"""(aggregate(sequence(1, greatest(length({_DIGITS}), 1)), 0, (s, i) -> s +
    transform(array(coalesce(try_cast(substr(reverse({_DIGITS}), i, 1) AS int), 0)), d ->
      IF(i % 2 = 1, d, IF(d > 4, 2 * d - 9, 2 * d)))[0]) % 10 = 0)"""
_VALID = f"""CASE c.kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN forall(split(c.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 9) AS int), 0) <= 255)
    WHEN 'card' THEN length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}
    ELSE length({_DIGITS}) BETWEEN 9 AND 15 END"""


def _candidates(text: str) -> str:
    """SQL: all candidate spans; texts without a digit or an at sign cost two scans."""
    digits = f"{text} RLIKE '[0-9]'"
    return f"""concat(
      IF(contains({text}, '@'), {_positions(text, EMAIL, 'email', True)}, {_NONE}),
      IF({digits}, {_positions(text, IP, 'ip', True)}, {_NONE}),
      IF({digits}, {_positions(text, CARD, 'card', True, 13)}, {_NONE}),
      IF({digits} AND contains({text}, '+'), {_positions(text, PHONE, 'phone', True)}, {_NONE}),
      IF({text} RLIKE '[\\\\[(]at[\\\\])]', {_positions(text, WRITTEN_EMAIL, 'email', False)}, {_NONE}),
      IF({digits}, {_positions(text, PLAIN_PHONE, 'phone', False)}, {_NONE}))"""


def _voted(text: str) -> str:
    """SQL lambda body: a candidate c with its base flag, votes and features."""
    before = f"lower(substr({text}, greatest(c.start - {CONTEXT_CHARS}, 0) + 1, least(c.start, {CONTEXT_CHARS})))"
    near = f"concat(IF(c.start > 0, substr({text}, c.start, 1), ' '), substr({text}, c.end + 1, 1))"
    ends = ", ".join(f"'{e}'" for e in DOMAIN_ENDS)
    known = f"""CASE c.kind
      WHEN 'email' THEN lower(regexp_extract(c.value, '([A-Za-z]+)$', 1)) IN ({ends})
      WHEN 'ip' THEN coalesce(try_cast(split(c.value, '[.]')[0] AS int), 0) BETWEEN 1 AND 223
      WHEN 'card' THEN {_DIGITS} RLIKE '{ISSUERS}'
      ELSE c.value RLIKE '{CALLING}' END"""
    return f"""named_struct('kind', c.kind, 'start', c.start, 'end', c.end,
      'base', c.strict AND {_VALID},
      'v', array(
        IF(c.strict, 1, -1),
        IF({_VALID}, 1, -1),
        IF({known}, 1, -1),
        IF({before} RLIKE '(^|[^a-z])({WORDS_FOR})[^a-z]', 1, 0),
        IF({before} RLIKE '(^|[^a-z])({WORDS_AGAINST})[^a-z]', -1, 0),
        IF({near} RLIKE '[A-Za-z0-9=_\\\\-]', -1, 1)))"""


def spans_of(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and `_found`: per row the candidates with votes, duplicates of a base span left out."""
    rows = documents.select(*keep, common.text_or_empty().alias("_text"))
    rows = rows.withColumn("_all", F.expr(_candidates("_text")))
    return rows.select(
        *keep,
        F.expr(f"transform(_all, c -> {_voted('_text')})").alias("_found"),
    )


_W = "get(w, {})"
_FEATURES = (
    "transform(array(c.v), v -> array(1.0D, cast(c.kind = 'email' AS double), cast(c.kind = 'ip' AS double), "
    "cast(c.kind = 'card' AS double), cast(v[0] AS double), cast(v[1] AS double), cast(v[2] AS double), "
    "cast(v[3] AS double), cast(v[4] AS double), cast(v[5] AS double), "
    "cast(v[1] = -1 AND v[3] < 1 AS double)))[0]"
)
_LABELERS = 6
_WEIGHTS = 11


def fit(found: DataFrame) -> DataFrame:
    """One row: `reliability` (log odds per labeler and vote, the prior last) and `weights` of the classifier."""
    patterns = (
        found.select(F.explode("_found").alias("c"))
        .groupBy("c.kind", "c.v")
        .agg(F.count("*").alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct("kind", "v", F.col("n").cast("double").alias("n")))).alias("p"))
    )
    # r[3j + vote + 1]: log odds that a labeler's vote speaks for personal data.
    logit = f"aggregate(sequence(0, {_LABELERS - 1}), r[{3 * _LABELERS}], (s, j) -> s + r[3 * j + x.v[j] + 1])"
    posterior = f"transform(p, x -> 1.0D / (1.0D + exp(-least(greatest({logit}, -30.0D), 30.0D))))"

    def total(q, condition="true"):
        return f"aggregate(zip_with(p, q, (x, y) -> IF({condition}, x.n * {q}, 0.0D)), 1.0D, (s, z) -> s + z)"

    vote = "get(x.v, m div 3) = m % 3 - 1"
    known = f"IF(m div 3 = 1, {PRIOR_SHARE}D * aggregate(p, 0.0D, (s, x) -> s + x.n), 0.0D)"
    update = f"""transform(array({posterior}), q -> transform(sequence(0, {3 * _LABELERS}), m ->
        IF(m = {3 * _LABELERS}, ln({total('y')} / {total('(1.0D - y)')}),
           ln(({total('y', vote)} + {known} * get({VALID_IF_PERSONAL}, m % 3)) / ({total('y')} + 2.0D + {known}))
         - ln(({total('(1.0D - y)', vote)} + {known} * get({VALID_IF_NOT}, m % 3)) / ({total('(1.0D - y)')} + 2.0D + {known})))))[0]"""
    # EM starts from the vote count, with the validity check (the second labeler) counted three times.
    start = (f"transform(sequence(0, {3 * _LABELERS}), m -> IF(m = {3 * _LABELERS}, 0.0D, "
             "cast(m % 3 - 1 AS double) * IF(m div 3 = 1, 3.0D, 1.0D)))")
    fitted = patterns.withColumn(
        "reliability", F.expr(f"aggregate(sequence(1, {EM_ROUNDS}), {start}, (r, i) -> {update})")
    ).withColumn("t", F.expr(f"transform(array(reliability), r -> zip_with(p, {posterior}, (c, y) -> "
                             f"named_struct('x', {_FEATURES}, 'n', c.n, 'y', y)))[0]"))
    dot = f"aggregate(sequence(0, {_WEIGHTS - 1}), 0.0D, (s, j) -> s + w[j] * a.x[j])"
    error = f"transform(t, a -> a.n * (a.y - 1.0D / (1.0D + exp(-least(greatest({dot}, -30.0D), 30.0D)))))"
    gradient = "aggregate(zip_with(t, e, (a, b) -> a.x[j] * b), 0.0D, (s, z) -> s + z)"
    step = f"""transform(array({error}), e -> transform(sequence(0, {_WEIGHTS - 1}), j ->
        w[j] * 0.999D + {STEP}D * {gradient} / aggregate(t, 1.0D, (s, a) -> s + a.n)))[0]"""
    return fitted.select(
        "reliability",
        F.expr(f"aggregate(sequence(1, {FIT_ROUNDS}), array_repeat(0.0D, {_WEIGHTS}), (w, i) -> {step})").alias("weights"),
    )


def decided(found: DataFrame, model: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds `_base` and `_spans` (base and added), each sorted by kind as listed, then start."""
    weights = model.select("weights").scalar()
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    score = f"aggregate(sequence(0, {_WEIGHTS - 1}), 0.0D, (s, j) -> s + _w[j] * {_FEATURES}[j])"
    as_sorted = f"named_struct('k', CASE c.kind {order} END, 'start', c.start, 'end', c.end, 'kind', c.kind)"
    return (
        found.withColumn("_w", weights)
        .withColumn("_base", F.expr(f"array_sort(transform(filter(_found, c -> c.base), c -> {as_sorted}))"))
        .withColumn(
            "_accepted",
            F.expr(
                f"""array_sort(transform(filter(_found, c -> NOT c.base
                   AND 1.0D / (1.0D + exp(-least(greatest({score}, -30.0D), 30.0D))) >= {threshold}D
                   AND NOT exists(_found, b -> b.base AND b.start < c.end AND c.start < b.end)),
                   c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind)))"""
            ),
        )
        .withColumn(
            "_more",
            F.expr(
                f"""transform(aggregate(_accepted, cast(array() AS array<struct<start:int,end:int,kind:string>>), (a, c) ->
                   IF(exists(a, b -> b.start < c.start AND c.start < b.end), a, concat(a, array(c)))), c -> {as_sorted})"""
            ),
        )
        .withColumn("_spans", F.expr("array_sort(array_distinct(concat(_base, _more)))"))
        .drop("_w", "_accepted", "_more")
    )


def _joined(column: str) -> str:
    return f"array_join(transform({column}, c -> concat_ws(':', c.kind, c.start, c.end)), ',')"


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and spans of every row."""
    # Candidates are few; staging them keeps the texts from being matched again for the fit.
    found = common.staged(spans_of(documents, ["doc_id"]), "pii")
    model = common.staged(fit(found), "pii-model")
    counts = [F.expr(f"cast(size(filter(_base, c -> c.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return decided(found, model).select(
        "doc_id", *counts, F.expr(f"sha2({_joined('_base')}, 256)").alias("base_sha256"),
        F.expr(_joined("_spans")).alias("spans"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """Every span becomes its kind in brackets; null texts stay null, other columns as they are but n_chars."""
    keep = [c for c in common.DOCUMENT_COLUMNS if c != "n_chars"]
    # Texts are staged with their candidates: written once more, but matched once.
    found = common.staged(spans_of(documents, keep), "pii-found")
    rows = decided(found, common.staged(fit(found), "pii-model"))
    by_start = "array_sort(transform(_spans, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind)))"
    pieces = f"""aggregate({by_start}, named_struct('at', 0, 'out', cast(array() AS array<string>)), (a, c) ->
        IF(c.start < a.at, named_struct('at', greatest(a.at, c.end), 'out', a.out), named_struct('at', c.end, 'out',
          concat(a.out, array(substr(text, a.at + 1, c.start - a.at), concat('[', upper(c.kind), ']'))))),
        a -> array_join(concat(a.out, array(substr(text, a.at + 1))), ''))"""
    clean = F.when(F.size("_spans") > 0, F.expr(pieces)).otherwise(F.col("text"))
    return rows.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("bigint")).select(
        *common.DOCUMENT_COLUMNS
    )
