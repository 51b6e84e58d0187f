"""Personal data spans by weak supervision (DataFrame functions only).

Candidates come from patterns: four base kinds with exact checks, and further kinds that
only the method decides. Labelers vote on each candidate (format, gazetteer, context,
surroundings: 1 for, 0 against, null abstains). Expectation-maximisation over the
histogram of vote patterns estimates how reliable each labeler is for each kind; the
resulting posteriors train a span classifier on surface features (naive Bayes with soft
counts), and the classifier decides which further spans are added. Base spans stay.

What reaches the driver is bounded by the labelers, not the corpus: at most
kinds x 3^labelers vote patterns and kinds x features x values counts. Spans, votes and
counts are computed over all documents.

A text's spans are placed by running sums in blocks, and overlaps are found after one sort, so
a text of many matches takes time in proportion to its length (and a little more).

Defined cases: a null text counts as empty and has no spans; rows are judged one by one,
so repeated rows get equal spans and null ids pass through; a table without candidates
gives empty spans; further columns of the input are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import saved, table

BASE = ("email", "ip", "card", "phone")

#: Patterns by kind. A possessive quantifier stands where giving back could never help,
#: and a look-behind where a match can only start at the start of a run, so that long
#: runs take linear time. \G lets a match start where the one before ended.
PATTERNS: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9)+] )(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![a-z0-9_])(?:token|secret|password|passwd|api_key|apikey)\x20?[=:]\x20?\x22?[A-Za-z0-9_+/-]{16,}+",
    "titled_name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
    "account": r"(?i)(?<![\p{L}0-9])(?:account|iban|konto|compte|cuenta|passport|member|customer|order|invoice|ticket|build|item|part)(?:\x20(?:no|nr|number|id))?[.:#]?\x20[A-Z]{0,2}[0-9]{6,12}+(?![0-9.-])",
    "birth_date": r"(?<![0-9./-])(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9./-])",
    "token": r"(?<![A-Za-z0-9_+/=.@:-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+(?![@.:=])",
}
KINDS = tuple(PATTERNS)
LABELERS = ("format", "gazetteer", "context", "surroundings")

#: Fixed word lists of the gazetteer and context labelers.
CONTEXT_FOR = "mail|email|contact|call|phone|tel|mobile|fax|card|visa|account|iban|address|ip|host|server|ssn|login|password|token|secret|key|bearer|credential|name|dear|von|de"
CONTEXT_AGAINST = "version|license|licence|isbn|issn|page|figure|fig|section|order|chapter|table|example|sample|dummy|placeholder|commit|hash|sha|md5|checksum|digest|uuid|etag|file|id|ref"
BIRTH = "born|birth|birthday|dob|geboren|geburtstag|naissance|née|né|nacido|nacida|nacimiento"
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
RESERVED_IP = r"^(?:0|127|255)\."
FIRST_NAMES = (
    "Anna|Maria|Laura|Julia|Emma|Sophie|Marie|Claire|Camille|Lucie|Carmen|Elena|Lucia|Sofia|Isabel|Alice|Jane|Mary|Sarah|Susan|Karen|Linda|Helen|Greta|Petra|Ute|"
    "John|James|Robert|Michael|William|David|Thomas|Peter|Paul|George|Hans|Karl|Klaus|Stefan|Jürgen|Wolfgang|Pierre|Jean|Louis|Michel|Luc|Antoine|José|Juan|Carlos|Luis|Miguel|Pablo|Diego"
)
PLACES = (
    "Berlin|Hamburg|Wien|Paris|Lyon|London|Oxford|Madrid|Sevilla|Boston|Chicago|Street|Road|Avenue|Square|Bridge|Park|Hill|Lake|River|"
    "University|College|School|Hospital|Museum|Library|Hotel|Street|Castle|Tower|Station|Company|Award|Prize|Law|Effect|Theorem"
)
KEY_STARTS = r"^(?:sk[-_]|pk[-_]|gh[pousr]_|xox[abp]-|AKIA|AIza|eyJ|glpat-)"
OWNED = r"(?i)^(?:account|iban|konto|compte|cuenta|passport|member|customer)"

MAX_LEFT, MAX_RIGHT = 40, 12
ROUNDS = 25


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, ends in 0."""
    backwards = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d: d.cast("int"))
    total = F.aggregate(
        F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))),
        F.lit(0),
        lambda s, d: s + d,
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The base kinds' exact checks; further kinds have none."""
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        digits = _digits(value)
        # Guarded: only sequences of a card's length are summed.
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _guard(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "titled_name":
        return text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b")
    if kind == "secret":
        return text.rlike(r"[=:]")
    if kind == "account":
        return text.rlike("[0-9]{6}")
    if kind == "birth_date":
        return text.rlike("(?:19|20)[0-9]{2}")
    if kind == "token":
        return text.rlike("[0-9]") & text.rlike("[A-Za-z0-9_+/-]{20}")
    return text.rlike("[0-9]")


SPAN = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"
#: Length of the blocks of a running aggregate, and levels of blocks of blocks.
BLOCK, LEVELS = 64, 3
_NAMES = count()


def _let(value: str, body: Callable[[str], str]) -> str:
    """SQL for ``body`` of a value that is computed once: an expression named within a lambda
    would be computed for each element."""
    name = f"v{next(_NAMES)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _running(values: str, zero: str, combine: str, levels: int = LEVELS) -> str:
    """SQL for, at each element, the aggregate (``combine`` of a and b) of those before it. An
    aggregate that appends to an array would copy it at every step; blocks bound that to BLOCK
    steps for each element and level."""

    def within(block: str, base: str) -> str:
        return f"transform({block}, (x, i) -> aggregate(slice({block}, 1, i), {base}, (a, b) -> {combine}))"

    def blocked(whole: str) -> str:
        number = f"cast(ceil(size({whole}) / {BLOCK}) as int)"
        cut = f"transform(sequence(0, {number} - 1), k -> slice({whole}, k * {BLOCK} + 1, {BLOCK}))"

        def joined(blocks: str) -> str:
            totals = f"transform({blocks}, y -> aggregate(y, {zero}, (a, b) -> {combine}))"
            part, base = f"p{next(_NAMES)}", f"b{next(_NAMES)}"
            return f"flatten(zip_with({blocks}, {_running(totals, zero, combine, levels - 1)}, ({part}, {base}) -> {within(part, base)}))"

        return f"if(size({whole}) <= {BLOCK}, {within(whole, zero)}, {_let(cut, joined)})"

    return _let(values, blocked if levels else lambda whole: within(whole, zero))


SUM, MOST, LEAST = "a + b", "greatest(a, b)", "least(a, b)"


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _matches(kind: str, text: str) -> Column:
    """Spans of one pattern with their surroundings.

    The text between matches and the matches themselves alternate, so positions in code
    points are running sums of their lengths."""
    pattern = _quoted(PATTERNS[kind])

    def spans(values: str, between: str, before: str) -> str:
        start = f"get({before}, i) + char_length(get({between}, i))"
        return (
            f"transform({values}, (v, i) -> named_struct('kind', '{kind}', 'start', {start}, 'end', {start} + char_length(v), 'value', v, "
            f"'left', right(get({between}, i), {MAX_LEFT}), 'right', left(get({between}, i + 1), {MAX_RIGHT})))"
        )

    def placed(values: str) -> str:
        def around(between: str) -> str:
            lengths = f"zip_with({between}, {values}, (b, v) -> char_length(b) + coalesce(char_length(v), 0))"
            return _let(_running(lengths, "0", SUM), lambda before: spans(values, between, before))

        return f"if(size({values}) > 0, {_let(f'split({text}, {pattern}, -1)', around)}, cast(array() as {SPAN}))"

    found = F.expr(_let(f"regexp_extract_all({text}, {pattern}, 0)", placed))
    return F.when(_guard(kind, F.col(text)), F.filter(found, lambda s: _valid(kind, s.value))).otherwise(F.array().cast(SPAN))


def _clear_of(spans: str, firm: str) -> Column:
    """``spans`` without those that overlap a span of ``firm``. In the order of their starts, a
    span overlaps one before it if the largest end so far lies behind its start, and one after
    it if the next start lies before its end."""
    last = str(2**31 - 1)

    def tagged(of: str, rank: int) -> str:
        return f"transform({of}, s -> named_struct('at', s.start, 'rank', {rank}, 'to', s.end, 'span', s))"

    def judged(order: str) -> str:
        ends = f"transform({order}, x -> if(x.rank = 0, x.to, -1))"
        starts = f"transform(reverse({order}), x -> if(x.rank = 0, x.at, {last}))"
        free = "x.rank = 1 and get({0}.before, i) <= x.at and get({0}.after, i) >= x.to"
        both = f"named_struct('before', {_running(ends, '-1', MOST)}, 'after', reverse({_running(starts, last, LEAST)}))"
        return _let(both, lambda near: f"transform(filter({order}, (x, i) -> {free.format(near)}), x -> x.span)")

    kept = _let(f"array_sort(concat({tagged(firm, 0)}, {tagged(spans, 1)}))", judged)
    return F.expr(f"if(size({spans}) > 0 and size({firm}) > 0, {kept}, {spans})")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): all candidates of a document, by kind as listed, then start. Further
    kinds that overlap a base span, and bare tokens that overlap a named secret, are dropped."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(id_col, *[_matches(k, "_text").alias(f"_{k}") for k in KINDS])
    base = F.concat(*[F.col(f"_{k}") for k in BASE])
    more = F.concat(*[F.col(f"_{k}") for k in KINDS if k not in (*BASE, "token")])
    firm = F.concat(base, F.col("_secret"))
    # Behind a generator, columns are computed once, however often they are named.
    parts = F.struct(base.alias("base"), more.alias("more"), firm.alias("firm"), F.col("_token").alias("token"))
    rows = rows.select(id_col, F.explode(F.array(parts)).alias("_s"))
    found = F.concat(F.col("_s.base"), _clear_of("_s.more", "_s.base"), _clear_of("_s.token", "_s.firm"))
    return rows.select(id_col, found.alias("spans"))


def votes(span: Column) -> dict[str, Column]:
    """One vote of each labeler on a candidate: 1, 0 or null."""
    kind, value, words, near = span.kind, span.value, F.lower(span.left), _near(span)
    none = F.lit(None).cast("int")
    domain = F.lower(F.substring_index(value, ".", -1))
    by_kind = {
        "format": F.when(kind == "email", F.when(value.rlike(r"^[A-Za-z0-9][^@]{0,62}[A-Za-z0-9]@|^[A-Za-z0-9]@"), 1).otherwise(0))
        .when(kind == "ip", F.when(value.rlike(r"(?:^|\.)0[0-9]"), 0).otherwise(1))
        .when(kind == "card", F.when(F.length(_digits(value)).isin(15, 16), 1).otherwise(0))
        .when(kind == "phone", F.when(F.length(_digits(value)).between(10, 13), 1).otherwise(0))
        .when(kind == "secret", F.when(value.rlike(r"[A-Za-z].*[0-9]{2}|[0-9].*[A-Za-z]{2}"), 1).otherwise(0))
        .when(kind == "national_id", F.when(value.rlike(r"^(?:000|666|9)|-00-|-0000$"), 0).otherwise(1))
        .when(kind == "token", F.when(value.rlike("^(?:[0-9a-f-]+|[0-9A-F-]+)$"), 0).when(value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9].*[0-9]"), 1).otherwise(0))
        .when(kind == "birth_date", F.when(value.rlike(r"20(?:1[5-9]|[2-9][0-9])"), 0).otherwise(none))
        .when((kind == "titled_name") & value.rlike(r"\p{L}\x20\p{L}+\x20\p{L}"), 1)
        .otherwise(none),
        "gazetteer": F.when(kind == "email", F.when(domain.rlike(f"^(?:{DOMAINS})$"), 1).otherwise(none))
        .when(kind == "ip", F.when(value.rlike(RESERVED_IP), 0).otherwise(1))
        .when(kind == "card", F.when(_digits(value).rlike(ISSUERS), 1).otherwise(none))
        .when(kind == "titled_name", F.when(value.rlike(rf"\x20(?:{PLACES})$"), 0).when(value.rlike(rf"\x20(?:{FIRST_NAMES})(?:\x20|$)"), 1).otherwise(none))
        .when(kind == "account", F.when(value.rlike(OWNED), 1).otherwise(0))
        .when(kind == "token", F.when(value.rlike(KEY_STARTS), 1).otherwise(none))
        .when(kind.isin("phone", "local_phone"), F.when(_digits(value).rlike(r"^1?0{3}"), 0).otherwise(1))
        .otherwise(none),
        "context": F.when(kind == "birth_date", F.when(words.rlike(rf"(?:^|[^\p{{L}}])(?:{BIRTH})(?![\p{{L}}])"), 1).otherwise(0))
        .otherwise(F.when(near == "against", 0).when(near == "for", 1)),
        # Standing free says little about words and numbers of plain text.
        "surroundings": F.when(kind == "birth_date", none).when(span.left.rlike(r"[\p{L}0-9_/=.-]$") | span.right.rlike(r"^[\p{L}0-9_/=-]"), 0)
        .when(kind.isin("account", "titled_name", "token"), none).otherwise(1),
    }
    return {name: by_kind[name].cast("int") for name in LABELERS}


def _near(span: Column) -> Column:
    """What the word before a span says: ``for``, ``against`` or ``none``."""
    words = F.lower(span.left)
    return (
        F.when(words.rlike(rf"(?:^|[^\p{{L}}])(?:{CONTEXT_AGAINST})[^\p{{L}}]{{1,8}}$"), "against")
        .when(words.rlike(rf"(?:^|[^\p{{L}}])(?:{CONTEXT_FOR})[^\p{{L}}]{{1,8}}$"), "for").otherwise("none")
    )


def features(span: Column) -> dict[str, Column]:
    """Surface features of a span, each with a small fixed set of values."""
    value = span.value
    share = F.length(_digits(value)) * 4 / F.length(value)
    birth = F.lower(span.left).rlike(rf"(?:^|[^\p{{L}}])(?:{BIRTH})(?![\p{{L}}])")
    return {
        "length": F.least(F.floor(F.length(value) / 4), F.lit(12)).cast("string"),
        "digits": F.floor(share).cast("string"),
        "left": F.when(span.left == "", "start").when(span.left.rlike(r"\p{L}$"), "letter").when(span.left.rlike("[0-9]$"), "digit").when(span.left.rlike(r"\s$"), "space").otherwise("sign"),
        "right": F.when(F.coalesce(span.right, F.lit("")) == "", "end").when(span.right.rlike(r"^\p{L}"), "letter").when(span.right.rlike("^[0-9]"), "digit").when(span.right.rlike(r"^\s"), "space").otherwise("sign"),
        "signs": F.least(F.length(F.regexp_replace(value, r"[\p{L}0-9]+", "")), F.lit(6)).cast("string"),
        "shape": F.when(value.rlike("^(?:[0-9a-f-]+|[0-9A-F-]+)$"), "hexadecimal").when(value.rlike("[a-z]") & value.rlike("[A-Z]"), "mixed").otherwise("plain"),
        "listed": F.when(value.rlike(rf"\x20(?:{PLACES})$"), "place").when(value.rlike(rf"\x20(?:{FIRST_NAMES})(?:\x20|$)"), "name").when(value.rlike(OWNED), "owned").when(value.rlike(KEY_STARTS), "key").otherwise("none"),
        "near": F.when((span.kind == "birth_date") & birth, "birth").otherwise(_near(span)),
    }


def reliabilities(histogram: list[tuple[str, tuple[int | None, ...], int]]) -> dict[tuple[str, tuple[int | None, ...]], float]:
    """Posterior of each (kind, vote pattern) from expectation-maximisation.

    Per kind a prior and, per labeler, the rate of a right vote on spans and on others,
    with a small Beta prior that labelers are right more often than not; starts from the
    majority. The histogram is bounded by kinds x 3^labelers."""
    posterior = {}
    for kind, pattern, _ in histogram:
        cast = [v for v in pattern if v is not None]
        posterior[kind, pattern] = (sum(cast) + 1) / (len(cast) + 2)
    for _ in range(ROUNDS):
        for kind in {k for k, _, _ in histogram}:
            rows = [(p, n, posterior[kind, p]) for k, p, n in histogram if k == kind]
            total = sum(n for _, n, _ in rows)
            prior = (sum(n * q for _, n, q in rows) + 2) / (total + 4)
            right = []
            for i in range(len(LABELERS)):
                seen = [(p[i], n, q) for p, n, q in rows if p[i] is not None]
                right.append((
                    (sum(n * q * v for v, n, q in seen) + 4) / (sum(n * q for _, n, q in seen) + 5),
                    (sum(n * (1 - q) * (1 - v) for v, n, q in seen) + 4) / (sum(n * (1 - q) for _, n, q in seen) + 5),
                ))
            for p, _, _ in rows:
                odds = math.log(prior / (1 - prior))
                for v, (yes, no) in zip(p, right):
                    if v is not None:
                        odds += math.log(yes / (1 - no)) if v else math.log((1 - yes) / no)
                posterior[kind, p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior


def train(found: DataFrame) -> dict[str, dict]:
    """The span classifier from all candidates of ``found`` (spans): log-odds by kind,
    feature and value, from soft counts of the posteriors."""
    span = F.col("span")
    each = found.select(F.explode("spans").alias("span"))
    counted = each.select(
        span.kind.alias("kind"),
        F.array(*[v for v in votes(span).values()]).alias("pattern"),
        *[f.alias(f"f_{name}") for name, f in features(span).items()],
    ).groupBy("kind", "pattern", *[f"f_{n}" for n in features(span)]).agg(F.count("*").alias("n"))
    counted = saved(counted, "pii-counts")
    histogram = [
        (r["kind"], tuple(r["pattern"]), r["n"]) for r in counted.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect()
    ]
    posterior = reliabilities(sorted(histogram, key=str))
    if not posterior:
        return {}
    codes = [F.struct(F.lit(k).alias("kind"), F.array(*[F.lit(v).cast("int") for v in p]).alias("pattern"), F.lit(q).alias("q")) for (k, p), q in posterior.items()]
    known = found.sparkSession.range(1).select(F.inline(F.array(*codes)))
    # `known` holds at most kinds x 3^labelers rows.
    joined = counted.join(F.broadcast(known), ["kind", "pattern"])
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f_{n}").alias("value")) for n in features(span)]))
    soft = joined.select("kind", values.alias("f"), "n", "q").groupBy("kind", "f.feature", "f.value").agg(
        F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")
    )
    model: dict[str, dict] = {}
    for r in sorted(soft.collect(), key=lambda r: (r["kind"], r["feature"], r["value"])):
        model.setdefault(r["kind"], {}).setdefault(r["feature"], {})[r["value"]] = (r["yes"], r["no"])
    out: dict[str, dict] = {}
    for kind, by in model.items():
        yes, no = (sum(x[i] for x in next(iter(by.values())).values()) for i in (0, 1))
        out[kind] = {("prior", ""): math.log((yes + 1) / (no + 1))}
        for feature, counts in by.items():
            for value, (y, n) in counts.items():
                out[kind][feature, value] = math.log((y + 1) / (yes + len(counts)) * (no + len(counts)) / (n + 1))
    return out


def _score(span: Column, model: dict[str, dict]) -> Column:
    """The classifier's probability for a span; a kind it never saw scores 0."""
    named = features(span)
    entries = [(f"{k}:{f}:{v}", w) for k, weights in model.items() for (f, v), w in weights.items()]
    if not entries:
        return F.lit(0.0)
    weights = F.create_map(*[x for key, w in entries for x in (F.lit(key), F.lit(float(w)))])
    keys = [F.concat(span.kind, F.lit(":prior:"))] + [F.concat(span.kind, F.lit(f":{n}:"), f) for n, f in named.items()]
    odds = reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at(weights, k), F.lit(0.0)) for k in keys])
    return 1 / (1 + F.exp(-odds))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, spans) after the classifier: base spans and the added ones it accepts."""
    found = saved(candidates(docs, id_col, text_col), "pii-candidates")
    model = train(found)
    more = F.filter("spans", lambda s: s.kind.isin(*BASE) | (_score(s, model) >= threshold))
    return found.select(id_col, more.alias("spans"))


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[x for k, i in rank.items() for x in (F.lit(k), F.lit(i))])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(order[s.kind].alias("k"), s.start.alias("s"), s.end.alias("e"), s.kind.alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s.kind, s.s, s.e)), ",")


#: Code points of a piece of text from which others are cut.
PIECE = 1024


def _replaced(text: str, spans: str) -> Column:
    """``text`` with the spans (s, e, k), in order, replaced by their kinds. The text is cut into
    pieces first, since a cut out of a text takes time in proportion to its place."""
    pieces = f"regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0)"

    def part(x: str, start: str, end: str) -> str:
        first, last = f"cast({start} div {PIECE} as int)", f"cast({end} div {PIECE} as int)"
        head, tail = f"coalesce(get({x}.pieces, {first}), '')", f"coalesce(get({x}.pieces, {last}), '')"
        inner = f"array_join(slice({x}.pieces, {first} + 2, greatest({last} - {first} - 1, 0)), '')"
        return (
            f"if({first} = {last}, substr({head}, {start} % {PIECE} + 1, greatest({end} - {start}, 0)), "
            f"concat(substr({head}, {start} % {PIECE} + 1), {inner}, substr({tail}, 1, {end} % {PIECE})))"
        )

    def written(x: str) -> str:
        each = f"transform({spans}, (s, i) -> if(s.s >= get({x}.at, i), concat({part(x, f'get({x}.at, i)', 's.s')}, '<', upper(s.k), '>'), ''))"
        end = f"greatest(element_at({x}.at, -1), element_at({spans}, -1).e)"
        return f"concat(array_join({each}, ''), {part(x, end, f'char_length({text})')})"

    at = _running(f"transform({spans}, s -> s.e)", "0", MOST)
    return F.expr(f"if(size({spans}) > 0, {_let(f"named_struct('pieces', {pieces}, 'at', {at})", written)}, {text})")


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` (columns of ``documents``) with every span replaced by its kind in angle
    brackets; ``n_chars`` follows where the table has it. Overlapping spans are replaced
    from the left, and one that starts within a replaced span goes with it."""
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text"))
    # Texts are searched once and written with their spans: the classifier learns from the spans
    # of the whole table before it decides on any.
    found = saved(candidates(keyed, "_row", "text"), "pii-candidates")
    model = train(found)
    accepted = F.filter("spans", lambda s: s.kind.isin(*BASE) | (_score(s, model) >= threshold))
    ordered = F.sort_array(F.transform(accepted, lambda s: F.struct(s.start.alias("s"), s.end.alias("e"), s.kind.alias("k"))))
    rows = found.select(F.explode(F.array(F.struct("_row", ordered.alias("spans")))).alias("_f"))
    rows = rows.select("_f._row", F.col("_f.spans").alias("_spans"), F.col("_f._row.text").alias("_text")).withColumn("_clean", _replaced("_text", "_spans"))
    changed = {"text": F.col("_clean"), "n_chars": F.when(F.size("_spans") > 0, F.char_length("_clean").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in columns else None}
    return rows.select(*[(changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
