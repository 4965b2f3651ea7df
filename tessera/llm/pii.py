"""Personal data by weak supervision, in DataFrame functions only.

Regex, gazetteer, checksum and context labelers vote on candidate spans. The table of vote patterns is tiny
(at most 4 kinds x 3^4 votes x 4 shapes), so expectation-maximisation over its counts and the training of the
span classifier run on the driver, whatever the size of the corpus. Spans of the base patterns always stay; the
classifier decides on candidates that the base patterns reject or do not see.

Null text counts as empty; a document without any span gets zero counts and the digest of the empty string.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")

# Possessive loops cannot backtrack, and \G or a look-behind skips starts inside a run that has already failed:
# both only save time, the matches are those of the plain patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
GATE = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9]\\.[0-9]'",
    "card": r"text rlike '[0-9][\\x20-]?[0-9]'",
    "phone": r"text rlike '\\+[0-9]'",
}
#: Spellings that the base patterns miss; groups of one pass over the text.
RELAXED = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"
    r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"
    r"|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"
)
# Gazetteers and context cues.
TOP_DOMAINS = "com net org edu gov mil int io co de fr es it nl uk eu us ca au jp cn ru br ch at be pl se".split()
CUES = {
    "email": "mail|contact|write to|reach|courriel|correo",
    "ip": r"\bip\b|server|host|addr|ping|adresse",
    "card": "card|visa|master|amex|credit|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|contact|handy|tél",
}
THRESHOLD = 0.9

SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,v:string,shape:string>>"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(matches: str, pieces: str) -> str:
    """Array of (value, left, start, end) in code points from the matches of a pattern and the pieces between them."""
    out = "array<struct<value:string,left:string,start:int,end:int>>"
    return f"""aggregate(zip_with({matches}, slice({pieces}, 1, size({matches})), (m, p) -> named_struct('m', m, 'p', p)),
        named_struct('at', 0, 'out', cast(array() as {out})),
        (a, x) -> named_struct('at', a.at + length(x.p) + length(x.m), 'out', concat(a.out, array(named_struct(
            'value', x.m, 'left', right(x.p, 40), 'start', a.at + length(x.p), 'end', a.at + length(x.p) + length(x.m))))),
        a -> a.out)"""


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = f"""coalesce(aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + case
    when i % 2 = 1 then int(substr({_DIGITS}, -i, 1))
    when int(substr({_DIGITS}, -i, 1)) > 4 then int(substr({_DIGITS}, -i, 1)) * 2 - 9
    else int(substr({_DIGITS}, -i, 1)) * 2 end) % 10 = 0, false)"""
_VALID = {
    "email": "true",
    "ip": r"forall(split(s.value, '\\.'), x -> double(x) <= 255)",
    "card": f"case when length({_DIGITS}) between 16 and 19 then {_LUHN} else false end",
    "phone": f"length({_DIGITS}) between 8 and 15",
}
_TLD = "array(" + ",".join(f"'{x}'" for x in TOP_DOMAINS) + ")"
#: Votes of the gazetteer labeler: + for, - against, 0 abstains.
_GAZETTEER = {
    "email": rf"if(array_contains({_TLD}, lower(regexp_extract(s.value, '([A-Za-z0-9-]+)$', 1))), '+', '0')",
    "ip": r"if(s.value rlike '^(0|127|255)\\.', '-', if(s.value rlike '^(10|192\\.168)\\.', '+', '0'))",
    "card": f"if({_DIGITS} rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65)', '+', '-')",
    "phone": f"if({_DIGITS} rlike '^(0+|1+|123456)$', '-', if(s.value rlike '^\\\\+(1|33|34|44|49)', '+', '0'))",
}
_CHECK = {
    "email": "if(length(s.value) between 6 and 254, '+', '-')",
    "ip": f"if({_VALID['ip'].replace('double(x)', 'try_cast(x as double)')}, '+', '-')",
    "card": f"if(case when length({_DIGITS}) between 13 and 19 then {_LUHN} else false end, '+', '-')",
    "phone": f"if(length({_DIGITS}) between 8 and 15, '+', '-')",
}


def _spans(kind: str, source: str, base: str, regex_vote: str) -> str:
    """Turn located matches into spans with their votes (regex, checksum, gazetteer, context)."""
    return f"""transform({source}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.end, 'base', {base},
        'v', concat({regex_vote}, {_CHECK[kind]}, {_GAZETTEER[kind]}, if(lower(s.left) rlike {_sql(CUES[kind])}, '+', '0')),
        'shape', case when s.end - s.start < 12 then 'a' when s.end - s.start < 20 then 'b' when s.end - s.start < 30 then 'c' else 'd' end))"""


def candidate_spans(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, spans)``: every candidate span of every document with its votes; base spans first, by kind."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k in KINDS:
        d = d.withColumn(f"m_{k}", F.expr(f"case when {GATE[k]} then regexp_extract_all(text, {_sql(BASE[k])}, 0) end"))
    gate = r"text rlike '[\\[({]at[\\])}]|:[0-9A-Fa-f]{1,4}:|[0-9]{3}[-.) ] ?[0-9]{3}[-. ][0-9]{4}'"
    d = d.withColumn("m_x", F.expr(f"case when {gate} then regexp_extract_all(text, {_sql(RELAXED)}, 0) end"))
    none = "cast(array() as array<struct<value:string,left:string,start:int,end:int>>)"
    pattern = {**{k: BASE[k] for k in KINDS}, "x": RELAXED}
    d = d.select(
        "doc_id",
        *[F.expr(f"case when size(m_{k}) > 0 then {_located(f'm_{k}', f'split(text, {_sql(p)}, -1)')} else {none} end").alias(f"l_{k}") for k, p in pattern.items()],
    )
    kind_x = r"case when x.value rlike '\\(at\\)|\\[at\\]|\\{at\\}' then 'email' when contains(x.value, ':') then 'ip' else 'phone' end"
    empty = f"cast(array() as {SPAN})"
    d = d.select(
        "doc_id",
        F.expr("concat(" + ",".join(f"case when size(l_{k}) > 0 then {_spans(k, f'filter(l_{k}, s -> {_VALID[k]})', 'true', chr(39) + '+' + chr(39))} else {empty} end" for k in KINDS) + ")").alias("base"),
        F.expr(
            "concat("
            + ",".join(f"case when size(l_{k}) > 0 then {_spans(k, f'filter(l_{k}, s -> not ({_VALID[k]}))', 'false', chr(39) + '-' + chr(39))} else {empty} end" for k in KINDS)
            + ","
            + ",".join(f"case when size(l_x) > 0 then {_spans(k, f'filter(l_x, x -> {kind_x} = {chr(39) + k + chr(39)})', 'false', chr(39) + '0' + chr(39))} else {empty} end" for k in ("email", "ip", "phone"))
            + ")"
        ).alias("more"),
    )
    return d.select("doc_id", F.expr("concat(base, filter(more, m -> not exists(base, b -> b.start < m.end and m.start < b.end)))").alias("spans"))


def fit_reliabilities(counts: dict[tuple[str, str], int], rounds: int = 40) -> dict[tuple[str, str], float]:
    """EM over (kind, votes) counts: each labeler has, by kind, a chance of each vote given a true or a false span.

    Starts from the majority vote. Returns the chance of a true span for each pattern.
    """
    post = {p: 0.5 + 0.4 * max(-1, min(1, p[1].count("+") - 2 * p[1].count("-"))) for p in counts}
    for _ in range(rounds):
        prior, vote = {}, {}
        for (kind, v), n in counts.items():
            q = post[kind, v]
            for y, w in ((1, q * n), (0, (1 - q) * n)):
                prior[kind, y] = prior.get((kind, y), 1.0) + w
                for i, x in enumerate(v):
                    vote[kind, y, i, x] = vote.get((kind, y, i, x), 0.0) + w
        for kind, v in post:
            # A weak belief that votes are more often right than wrong keeps the two classes from trading places.
            score = [math.log(prior[kind, y]) for y in (0, 1)]
            for i, x in enumerate(v):
                for y in (0, 1):
                    hint = {"+": (1.0, 4.0), "-": (4.0, 1.0), "0": (2.0, 2.0)}[x][y]
                    score[y] += math.log((vote.get((kind, y, i, x), 0.0) + hint) / (prior[kind, y] + 7.0))
            post[kind, v] = 1 / (1 + math.exp(max(-50, min(50, score[0] - score[1]))))
    return post


def train_classifier(rows: list[tuple[str, str, str, int]], post: dict[tuple[str, str], float], steps: int = 400) -> dict[tuple[str, str, str], float]:
    """Weighted logistic regression of the EM posteriors on votes and shape, fitted on the table of patterns."""
    def features(kind, v, shape):
        return ["1", kind, kind + shape, *(f"{kind}{i}{x}" for i, x in enumerate(v)), *(f"{i}{x}" for i, x in enumerate(v))]

    w: dict[str, float] = {}
    total = {k: sum(n for kk, *_, n in rows if kk == k) for k in KINDS}
    chance = lambda f: 1 / (1 + math.exp(-max(-50, min(50, sum(w.get(x, 0.0) for x in f)))))
    data = [(features(k, v, s), post[k, v], 0.02 + n / max(1, total[k])) for k, v, s, n in rows]
    for _ in range(steps):
        step: dict[str, float] = {}
        for f, y, n in data:
            g = n * (y - chance(f))
            for x in f:
                step[x] = step.get(x, 0.0) + g
        for x, g in step.items():
            w[x] = w.get(x, 0.0) + 0.5 * g - 1e-4 * w.get(x, 0.0)
    return {(k, v, s): chance(features(k, v, s)) for k, v, s, _ in rows}


def find_pii(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, spans)``; each span has kind, start, end (code points, end exclusive) and base.

    Repeated doc_ids give a row each. Extra columns are ignored. Spans are ordered by kind as in KINDS, then start;
    added spans never overlap a base span.
    """
    found = materialize(candidate_spans(docs), "pii")
    table = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.v", "s.shape").agg(F.count("*").alias("n"))
    rows = sorted((r.kind, r.v, r.shape, r.n) for r in table.collect())  # at most 4 * 81 * 4 rows
    counts: dict[tuple[str, str], int] = {}
    for k, v, _, n in rows:
        counts[k, v] = counts.get((k, v), 0) + n
    chances = train_classifier(rows, fit_reliabilities(counts)) if rows else {}
    good = ["".join(p) for p, c in chances.items() if c >= THRESHOLD] or ["none"]
    keep = F.filter("spans", lambda s: s["base"] | F.concat(s["kind"], s["v"], s["shape"]).isin(good))
    rank = F.expr("transform(kept, s -> named_struct('o', array_position(array('email','ip','card','phone'), s.kind), 'start', s.start, 'end', s.end, 'kind', s.kind, 'base', s.base))")
    return found.select("doc_id", keep.alias("kept")).select("doc_id", F.array_sort(rank).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by ``<KIND>``; other columns and their order stay.

    Rows are handled one by one, so repeated and null doc_ids need nothing; null text stays null.
    """
    found = find_pii(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"))
    marks = "array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    cut = F.expr(
        f"""case when size(spans) = 0 then doc_id.text else aggregate({marks}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> case when s.start < a.at then a else named_struct('at', s.end, 'out',
            concat(a.out, array(substr(doc_id.text, a.at + 1, s.start - a.at), concat('<', upper(s.kind), '>')))) end,
        a -> concat(array_join(a.out, ''), substr(doc_id.text, a.at + 1))) end"""
    )
    own = lambda c: F.col("doc_id").getField(c)
    rows = found.withColumn("cut", cut)
    return rows.select(*[F.col("cut").alias(c) if c == "text" else F.length("cut").cast(t).alias(c) if c == "n_chars" else own(c).alias(c) for c, t in docs.dtypes])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns over all of ``documents``."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS],
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
