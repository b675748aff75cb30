"""Personal data by weak supervision, in DataFrame operations alone.

Base spans come from fixed patterns. Wider patterns propose further candidates,
on which labelers vote: a format labeler (checksums and lengths), a gazetteer
labeler (the word before), a context labeler (what encloses the span) and a
shape labeler (the mix of characters). Expectation-maximisation over the counts
of all vote patterns estimates each labeler's reliability; the posteriors then
train a classifier over span features, whose verdict adds spans to the base.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gneiss.staging import stage

#: Fixed patterns of the four base kinds. Possessive where nothing can be given back, so long runs stay linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Candidates beyond the base kinds: (kind, pattern, a condition without which it cannot match, {t} the text). Runs are
#: possessive and start where no such run goes on, so they stay linear and none is cut off.
WIDER = (
    ("secret", r"(?i)\b(?:api[_-]?key|secret(?:[_-]?key)?|(?:auth|access)?[_-]?token|access[_-]?key|client[_-]?secret)\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9+/_.=-]{8,}+", "{t} rlike '(?i)key|secret|token'"),
    ("secret", r"(?i)\b(?:password|passwd|passphrase|pwd)\s{0,3}[=:]\s{0,3}[\x22']?[^\s\x22']{6,}+", "{t} rlike '(?i)passw|passphrase|pwd'"),
    ("secret", r"-----BEGIN (?:[A-Z]++ )*+PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]++ )*+PRIVATE KEY-----)?", "contains({t}, 'PRIVATE KEY')"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", "{t} rlike '[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}'"),
    ("passport", r"(?i)\bpassport(?:\x20(?:no|nr|number))?[.:#]{0,2}\x20{0,2}(?=[A-Z]*[0-9])[A-Z0-9]{6,9}\b", "{t} rlike '(?i)passport'"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "{t} rlike '[0-9]-[0-9]{{2}}-[0-9]{{4}}'"),
    ("phone", r"(?<![0-9+])(?<![0-9][\x20.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])", "{t} rlike '[0-9][ .-][0-9]{{4}}'"),
    ("account", r"(?<![0-9+])(?<![0-9][.-])[0-9]{9,19}(?![0-9]|[.-][0-9])", "{t} rlike '[0-9]{{9}}'"),
    ("email", r"(?i)(?<![A-Za-z0-9._-])[a-z0-9._-]++ ?(?:\(at\)|\[at\]) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]) ?[a-z0-9-]++)++", "contains(lower({t}), 'at)') or contains(lower({t}), 'at]')"),
)
#: Words that introduce personal data, and words that introduce numbers of other sorts.
GAZETTEER = tuple(
    "account acct address bank billing call card cell cellphone contact customer dial direct email fax home iban id identity key kontakt konto login mail member mobile mobil no nr number office passport passwort password patient phone pin portable "
    "reach secret sms social ssn tel telefon telefono telephone text token user username whatsapp work".split()
)
OTHERWISE = tuple("article chapter column figure fig invoice isbn issn issue item line lot model order page part post product sample section serial sku step table ticket version vol volume year".split())
#: Votes: 1 personal, 0 not, null abstains. Rounds and the prior's pseudo-counts of expectation-maximisation.
LABELERS, ROUNDS, PSEUDO = 4, 60, 2.0
#: Probability from which a candidate is a span.
ACCEPT = 0.5
BLOCK = 256


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def span_columns(df: DataFrame, text: str, pattern: str, out: str, needs: str) -> DataFrame:
    """df with out: array of (s, e, m), the leftmost non-overlapping matches of a pattern, places in code points.

    A match starts behind the pieces and matches before it. Their lengths are
    summed by blocks, so a text with very many matches stays near linear. needs
    is a cheap condition without which there is no match.
    """
    hit = f"case when {needs} then regexp_extract_all({text}, {quoted(pattern)}, 0) else array() end"
    df = df.withColumn("__m", F.expr(f"cast({hit} as array<string>)"))
    df = df.withColumn("__p", F.expr(f"case when size(__m) > 0 then split({text}, {quoted(pattern)}) end"))
    lengths = "transform(sequence(0, 2 * size(__m) - 1), i -> if(i % 2 = 0, length(__p[cast(i div 2 as int)]), length(__m[cast(i div 2 as int)])))"
    df = df.withColumn("__l", F.expr(f"case when size(__m) > 0 then {lengths} end"))
    sums = f"transform(sequence(0, cast((size(__l) - 1) div {BLOCK} as int)), b -> aggregate(slice(__l, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x))"
    df = df.withColumn("__b", F.expr(f"case when size(__m) > 0 then {sums} end"))
    before = "transform(sequence(0, size(__b) - 1), b -> aggregate(slice(__b, 1, b), 0, (a, x) -> a + x))"
    df = df.withColumn("__b", F.expr(f"case when size(__m) > 0 then {before} end"))
    start = f"__b[cast((2 * i + 1) div {BLOCK} as int)] + aggregate(slice(__l, cast((2 * i + 1) div {BLOCK} as int) * {BLOCK} + 1, (2 * i + 1) % {BLOCK}), 0, (a, x) -> a + x)"
    spans = f"transform(sequence(0, size(__m) - 1), i -> named_struct('s', {start}, 'm', __m[i]))"
    spans = f"transform({spans}, x -> named_struct('s', x.s, 'e', x.s + length(x.m), 'm', x.m))"
    df = df.withColumn(out, F.expr(f"case when size(__m) > 0 then {spans} else cast(array() as array<struct<s: int, e: int, m: string>>) end"))
    return df.drop("__m", "__p", "__l", "__b")


def luhn(digits: str) -> str:
    """SQL for the Luhn sum of a string of digits."""
    digit = f"cast(substring({digits}, length({digits}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, k) -> a + if(k % 2 = 0, {digit}, {digit} * 2 - if({digit} > 4, 9, 0)))"


def mod97(text: str) -> str:
    """SQL for the checksum of an account number with a country code: 1 if it is right."""
    bare = f"replace({text}, ' ', '')"
    turned = f"concat(substring({bare}, 5), substring({bare}, 1, 4))"
    value = "if(c between '0' and '9', ascii(c) - 48, ascii(c) - 55)"
    return f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (a, c) -> (a * if(c between '0' and '9', 10, 100) + {value}) % 97)"


def small(part: str) -> str:
    """SQL: a string of digits is at most 255."""
    return f"coalesce(cast(nullif(substring(concat('0', ltrim('0', {part})), 1, 5), '') as int) <= 255, false)"


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with email, ip, card and phone: the base spans of each kind."""
    df = span_columns(docs, text, EMAIL, "email", f"contains({text}, '@')")
    df = span_columns(df, text, IP, "ip", f"{text} rlike '[0-9]\\\\.[0-9]'")
    df = df.withColumn("ip", F.expr(f"filter(ip, x -> forall(split(x.m, '[.]'), p -> {small('p')}))"))
    df = span_columns(df, text, CARD, "card", f"{text} rlike '[0-9][ -]?[0-9]'")
    plain = "replace(replace(x.m, ' ', ''), '-', '')"
    df = df.withColumn("card", F.expr(f"filter(card, x -> if(length({plain}) between 16 and 19, {luhn(plain)} % 10 = 0, false))"))
    df = span_columns(df, text, PHONE, "phone", f"contains({text}, '+')")
    return df.withColumn("phone", F.expr("filter(phone, x -> length(regexp_replace(x.m, '[^0-9]', '')) between 8 and 15)"))


def word_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with wider: array of (kind, s, e, m, before, after) of candidates that no base span touches."""
    names = []
    for k, (kind, pattern, needs) in enumerate(WIDER):
        name = f"w{k}"
        names.append(name)
        df = span_columns(df, text, pattern, name, needs.format(t=text))
        around = f"'before', substring({text}, greatest(x.s - 23, 1), least(x.s, 24)), 'after', substring({text}, x.e + 1, 8)"
        df = df.withColumn(name, F.expr(f"transform({name}, x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e, 'm', x.m, {around}))"))
    everything = f"concat({', '.join(KINDS)})"
    free = f"filter(concat({', '.join(names)}), x -> not exists({everything}, y -> y.s < x.e and x.s < y.e))"
    # of overlapping candidates the one of the pattern listed first stays
    df = df.withColumn("wider", F.expr(free)).drop(*names)
    return df.withColumn("wider", F.expr("filter(wider, (x, i) -> not exists(slice(wider, 1, i), y -> y.s < x.e and x.s < y.e))"))


def votes(x: str) -> list[str]:
    """SQL of the labelers' votes on a candidate struct."""
    digits = f"regexp_replace({x}.m, '[^0-9]', '')"
    last = f"lower(regexp_extract({x}.before, '([A-Za-z]+)[^A-Za-z]{{0,4}}$', 1))"
    form = (
        f"case {x}.kind when 'account' then if(length({digits}) >= 13, if({luhn(digits)} % 10 = 0, 1, 0), cast(null as int)) "
        f"when 'iban' then if({mod97(f'{x}.m')} = 1, 1, 0) when 'ssn' then if({digits} rlike '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)', 1, 0) "
        f"when 'phone' then if(length({digits}) = 10 and substring({digits}, 1, 1) not in ('0', '1'), 1, 0) when 'secret' then if(length({x}.m) >= 24, 1, 0) else 1 end"
    )
    gazetteer = f"case when {last} in ({word_list(GAZETTEER)}) or {x}.kind in ('secret', 'passport') then 1 when {last} in ({word_list(OTHERWISE)}) then 0 end"
    context = f"case when {x}.before rlike '[=:#][^A-Za-z0-9]{{0,3}}$' or {x}.m rlike '[=:]' then 1 when {x}.before rlike '[$%/]$' or {x}.after rlike '^[%/]' then 0 end"
    shape = (
        f"case when {x}.kind = 'secret' then if({x}.m rlike '[=:].*[0-9]' and {x}.m rlike '(?i)[=:].*[a-z]', 1, 0) "
        f"when {x}.kind = 'passport' then if({digits} <> '', 1, 0) when {digits} rlike '^([0-9])\\\\1+$' then 0 when {x}.kind = 'account' then cast(null as int) else 1 end"
    )
    return [form, gazetteer, context, shape]


def estimate(patterns: list[tuple[str, tuple[int | None, ...], int]]) -> dict[tuple[str, tuple[int | None, ...]], float]:
    """Posterior of being personal data for each (kind, votes), by expectation-maximisation over pattern counts.

    Labelers are taken to err independently within a kind; the prior says that
    a labeler is right four times out of five and half of the candidates are real.
    """
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        share, hit, miss = 0.5, [0.8] * LABELERS, [0.2] * LABELERS
        post: list[float] = []
        for _ in range(ROUNDS):
            post = []
            for v, _n in own:
                odds = math.log(share / (1 - share))
                for j, vote in enumerate(v):
                    if vote is not None:
                        odds += math.log(hit[j] / miss[j]) if vote else math.log((1 - hit[j]) / (1 - miss[j]))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            total = sum(n for _, n in own)
            real = sum(n * p for (_, n), p in zip(own, post, strict=True))
            share = (real + PSEUDO) / (total + 2 * PSEUDO)
            for j in range(LABELERS):
                voted = [(v[j], n, p) for (v, n), p in zip(own, post, strict=True) if v[j] is not None]
                hit[j] = (sum(n * p for x, n, p in voted if x) + 0.8 * PSEUDO) / (sum(n * p for _, n, p in voted) + PSEUDO)
                miss[j] = (sum(n * (1 - p) for x, n, p in voted if x) + 0.2 * PSEUDO) / (sum(n * (1 - p) for _, n, p in voted) + PSEUDO)
                hit[j], miss[j] = max(hit[j], miss[j] + 1e-3), min(miss[j], 0.999)
                hit[j] = min(hit[j], 0.9999)
        out |= {(kind, v): p for (v, _), p in zip(own, post, strict=True)}
    return out


#: Features of a candidate and their number of values; a kind's classifier adds one weight for each.
FEATURES = {
    "length": "least(cast(length(x.m) div 4 as int), 15)",
    "opens": "case when x.before rlike '[A-Za-z]$' then 0 when x.before rlike '[0-9]$' then 1 when x.before rlike ' $' then 2 when x.before = '' then 3 else 4 end",
    "closes": "case when x.after rlike '^[A-Za-z]' then 0 when x.after rlike '^[0-9]' then 1 when x.after rlike '^ ' then 2 when x.after = '' then 3 else 4 end",
    "ballot": "aggregate(x.votes, 0, (a, v) -> a * 3 + coalesce(v, 2))",
}


def train(rows: DataFrame, posterior: dict[tuple[str, tuple[int | None, ...]], float]) -> dict[tuple[str, str, int], float]:
    """Weights of a naive Bayes classifier on soft labels; counts are over all candidates, one row a feature value."""
    stacked = ", ".join(f"named_struct('f', '{n}', 'v', cast(x.{n} as int))" for n in FEATURES)
    counts = rows.select("x.kind", "x.votes", F.explode(F.expr(f"array({stacked})")).alias("y")).groupBy("kind", "votes", "y.f", "y.v").count().collect()
    real: dict[tuple[str, str, int], float] = {}
    other: dict[tuple[str, str, int], float] = {}
    for r in counts:
        p = posterior[r["kind"], tuple(r["votes"])]
        key = (r["kind"], r["f"], r["v"])
        real[key] = real.get(key, 0.0) + p * r["count"]
        other[key] = other.get(key, 0.0) + (1 - p) * r["count"]
    weights = {}
    for kind in {k for k, _, _ in real}:
        a = sum(n for (k, f, _), n in real.items() if k == kind and f == "length")
        b = sum(n for (k, f, _), n in other.items() if k == kind and f == "length")
        weights[kind, "prior", 0] = math.log((a + 1) / (b + 1))
        for key in [k for k in real if k[0] == kind]:
            weights[key] = math.log((real[key] + 0.5) / (a + 1)) - math.log((other[key] + 0.5) / (b + 1))
    return weights


def classify(weights: dict[tuple[str, str, int], float]) -> str:
    """SQL of the probability that candidate x is personal data."""
    entries = ", ".join(f"'{k}|{f}|{v}', {w!r}D" for (k, f, v), w in sorted(weights.items()))
    if not entries:
        return "0.0D"
    look = lambda f, v: f"coalesce(try_element_at(map({entries}), concat(x.kind, '|{f}|', {v})), 0.0D)"
    terms = [look("prior", "'0'"), *[look(f, f"cast(x.{f} as string)") for f in FEATURES]]
    return f"1 / (1 + exp(-({' + '.join(terms)})))"


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base and added spans of personal data for every row of docs.

    doc_id; base: array of (kind, s, e), the fixed patterns' spans by kind and
    start; found: base and added spans in the same order (kinds beyond the four
    come after them by name); places are code points, the end exclusive. A null
    or empty text has none. Rows are judged alone but for the labelers'
    reliabilities, which are estimated over all rows, so repeated rows agree.
    Extra columns are not read; an empty table gives an empty result. Only
    spans and a few characters around candidates are staged, never whole texts.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = candidates(base_spans(source)).drop("text")
    struct = ", ".join(f"'{n}', x.{n}" for n in ("kind", "s", "e", "m", "before", "after"))
    rows = rows.withColumn("wider", F.expr(f"transform(wider, x -> named_struct({struct}, 'votes', array({', '.join(votes('x'))})))"))
    features = ", ".join(f"'{n}', {e}" for n, e in FEATURES.items())
    rows = rows.withColumn("wider", F.expr(f"transform(wider, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'votes', x.votes, {features}))"))
    base = ", ".join(f"transform({k}, x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e))" for k in KINDS)
    rows = stage(rows.select("doc_id", F.expr(f"concat({base})").alias("base"), "wider"), "spans")
    proposed = rows.filter(F.size("wider") > 0).select(F.explode("wider").alias("x"))
    patterns = [(r["kind"], tuple(r["votes"]), r["count"]) for r in proposed.groupBy("x.kind", "x.votes").count().collect()]
    weights = train(proposed, estimate(patterns))
    added = f"transform(filter(wider, x -> {classify(weights)} >= {ACCEPT}), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"
    rank = " ".join(f"when '{k}' then '{i}'" for i, k in enumerate(KINDS))
    order = f"x -> named_struct('o', case x.kind {rank} else concat('9', x.kind) end, 's', x.s, 'e', x.e, 'kind', x.kind)"
    return rows.select("doc_id", "base", F.expr(f"transform(array_sort(transform(concat(base, {added}), {order})), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))").alias("found"))


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text, for every row of docs."""
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return personal_data(docs).select("doc_id", *counts, F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined("found")).alias("spans"))
