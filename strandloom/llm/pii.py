"""PII by weak supervision, with DataFrame functions alone.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates (addresses spelt out,
local phone numbers, national ids, bank accounts, titled names) come from wider patterns. Three labelers vote on every
candidate, base ones too: a strict format, a gazetteer, and the words around it; a vote is for, against or no opinion.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability; no labeler is taken to be
worse than chance. A logistic span classifier is trained on the posteriors it gives, over all candidates of all documents,
by votes, kind, length and share of digits of the span, and decides on the further ones.
Only counts of patterns (kinds x 27 votes x 16 forms at most) reach the driver.

Positions count code points, ends are exclusive. They come from the lengths of what stands between the matches. The cost
of a text grows with its length and matches, not with their square.

Defined results: null and empty texts have no span; repeated rows each get their row; an empty table gives an empty
one, and the classifier then has its starting weights; extra columns are not used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """pattern finds candidates. strict (of the match), gazetteer (in the match), near and against (around it) vote."""

    name: str
    pattern: str
    strict: str
    gazetteer: str
    near: str
    against: str
    guard: str
    base: bool = False


# Common given and family names, providers of mail, endings of domains, calling codes and countries of IBANs.
NAMES = "|".join("""
James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan
Jessica Sarah Karen Jane Peter Paul Anna Emma Julia Laura Maria Hans Klaus Jürgen Wolfgang Stefan Andreas Ursula Sabine Petra
Monika Heike Pierre Jean Michel Philippe Alain Nicolas Marie Nathalie Isabelle Sylvie Catherine José Antonio Manuel Francisco
Juan Javier Carmen Ana Isabel Dolores Pilar Smith Johnson Williams Brown Jones Miller Davis Wilson Taylor Müller Schmidt
Schneider Fischer Weber Meyer Wagner Becker Martin Bernard Dubois Durand Leroy Moreau García González Rodríguez Fernández
López Martínez Sánchez Pérez
""".split())
PROVIDERS = "gmail|googlemail|yahoo|outlook|hotmail|live|msn|icloud|me|aol|mail[0-9]*|proton|protonmail|gmx|web|t-online|freenet|orange|laposte|free|wanadoo|telefonica|yandex|zoho|fastmail"
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|at|be|ch|eu"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|38[1-79]|42[01]|97[1-7]"
COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK"

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A run of local characters is only tried from its start or from the last match's end, and is not given back: the
#: matches are the same, and a long run costs one step for each character.
KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@.*\.[A-Za-z]{2,}$", rf"(?i)@({PROVIDERS})\b|\.({ENDINGS})$", r"(?i)\b(e-?mail|contact|write|reach|courriel|correo)\b", r"(?i)\b(noreply|example only|placeholder)\b", "@", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"^{OCTET}(?:\.{OCTET}){{3}}$", r"^(10|127|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\.", r"(?i)\b(ip|host|server|address|login|from)\b", r"(?i)\b(version|release|v|section)\b", ".", True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}$", r"^[3456]", r"(?i)\b(card|visa|master|credit|debit|pay|karte|carte|tarjeta)\b", r"(?i)\b(isbn|order|tracking|serial)\b", "[0-9][ -]?[0-9]", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"^\+[1-9][0-9]{0,2}[ .(-]", rf"^\+({CALLING})(?![0-9])", r"(?i)\b(phone|tel|call|mobile|fax|contact|reach)\b", r"(?i)\b(score|delta|gain)\b", "+", True),
    Kind("spelt_email", rf"(?i)\b[a-z0-9._-]{{2,64}} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{{2,63}} ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{{2,6}}\b", r"[\[(]at[\])]", rf"(?i)({ENDINGS})$", r"(?i)\b(e-?mail|contact|write|reach|courriel|correo)\b", r"(?i)\b(look|meet|arrive)\b", "(?i)at[ )\\]]"),
    Kind("local_phone", r"(?<![0-9+(.-])(?<![0-9+] )(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"^\(?[2-9][0-8][0-9]\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}$", r"\b555\b|^\(", r"(?i)\b(phone|tel|call|mobile|fax|contact|reach)\b", r"(?i)\b(isbn|order|part|serial|version)\b", "[0-9]{3}[ .-][0-9]{4}"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^$", r"(?i)\b(ssn|social|security|passport|taxpayer|identity|id)\b", r"(?i)\b(isbn|order|part|serial|version)\b", "[0-9]-[0-9]{2}-[0-9]"),
    Kind("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}[ 0-9]{12,}$", rf"^({COUNTRIES})", r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b", r"(?i)\b(key|hash|serial|code)\b", "[A-Z]{2}[0-9]{2}"),
    Kind("name", r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Madame|Monsieur|Señor|Señora)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?", r"\. ?\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$", rf"\b({NAMES})\b", r"(?i)\b(name|signed|dear|born|called|contact)\b", r"(?i)\b(street|road|avenue|prize)\b", "Mr|Ms|Dr|Herr|Frau|Mme|Mada|Mons|Señor"),
)
CONTEXT = 40
GATHERED = 64
LABELERS = ("strict", "gazetteer", "context")
FORMS = 16


def _places(text: Column, pattern: str) -> Column:
    """array<struct<a, b, m, c>>: start, end and text of each match, and the text around it as far as the next match of the
    kind, CONTEXT characters at most."""

    def joined(x: Column) -> Column:
        # Taken from the gaps between matches, so that no match is looked up in the whole text again.
        n = F.size(x["found"])
        around = F.zip_with(
            F.slice(x["gaps"], F.lit(1), n),
            F.slice(x["gaps"], F.lit(2), n),
            lambda g, h: F.struct(F.length(g).alias("g"), F.concat(F.substring(g, -CONTEXT, CONTEXT), F.lit(" \u0001 "), F.substring(h, 1, CONTEXT // 2)).alias("c")),
        )
        return F.zip_with(around, x["found"], lambda g, m: F.struct(g["g"].alias("g"), F.length(m).alias("n"), m.alias("m"), g["c"].alias("c")))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    pairs = F.element_at(F.transform(F.array(parts), joined), 1)
    spans = "array<struct<a:int,b:int,m:string,c:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("last"), F.array().cast(f"array<{spans}>").alias("full"))

    def step(acc: Column, x: Column) -> Column:
        # Appending copies an array, so spans are gathered by GATHERED first.
        a = acc["at"] + x["g"]
        more = F.array_append(acc["last"], F.struct(a.alias("a"), (a + x["n"]).alias("b"), x["m"].alias("m"), x["c"].alias("c")))
        whole = F.size(acc["last"]) == GATHERED - 1
        return F.struct(
            (a + x["n"]).alias("at"),
            F.when(whole, F.array().cast(spans)).otherwise(more).alias("last"),
            F.when(whole, F.array_append(acc["full"], more)).otherwise(acc["full"]).alias("full"),
        )

    return F.aggregate(pairs, start, step, lambda acc: F.flatten(F.array_append(acc["full"], acc["last"])))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.split(F.reverse(_digits(m)), "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _accepted(kind: Kind, m: Column) -> Column:
    if kind.name == "ip":
        return m.rlike(kind.strict)
    if kind.name == "card":
        return _luhn(m)
    if kind.name == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _found(kind: Kind, text: Column) -> Column:
    """Accepted matches of a kind."""
    guard = text.contains(kind.guard) if len(kind.guard) == 1 else text.rlike(kind.guard)
    none = F.array().cast("array<struct<a:int,b:int,m:string,c:string>>")
    return F.when(guard & text.rlike(kind.pattern), F.filter(_places(text, kind.pattern), lambda s: _accepted(kind, s["m"]))).otherwise(none)


def _votes(kind: Kind, span: Column) -> Column:
    """The three votes, each 0 against, 1 none, 2 for, and the form of the span as one number from 0 to 27 * FORMS - 1."""
    m, around = span["m"], span["c"]
    strict = F.when(m.rlike(kind.strict), 2).otherwise(0)
    gazetteer = F.when(m.rlike(kind.gazetteer), 2).otherwise(1)
    context = F.when(around.rlike(kind.near), 2).when(around.rlike(kind.against), 0).otherwise(1)
    return ((strict * 9 + gazetteer * 3 + context) * FORMS + _form(m)).cast("int")


def _form(m: Column) -> Column:
    """0 to 15: four classes of the span's length and four of its share of digits."""
    n = F.length(m)
    digits = F.length(_digits(m))
    long = (n > 11).cast("int") + (n > 15).cast("int") + (n > 23).cast("int")
    share = (digits > 0).cast("int") + (digits * 2 > n).cast("int") + (digits * 10 > n * 9).cast("int")
    return long * 4 + share


def candidates(docs: DataFrame, text="text") -> DataFrame:
    """docs with a column for each kind: array<struct<a, b, votes>>."""
    body = F.coalesce(F.col(text), F.lit(""))

    def voted(kind: Kind) -> Column:
        return F.transform(_found(kind, body), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), _votes(kind, s).alias("votes")))

    return docs.select("*", *[voted(kind).alias(f"_{kind.name}") for kind in KINDS])


def _unpack(pattern: int) -> tuple[int, int, int]:
    votes = pattern // FORMS
    return votes // 9 - 1, votes // 3 % 3 - 1, votes % 3 - 1


def posteriors(counts: dict[tuple[str, int], int], rounds: int = 50) -> dict[tuple[str, int], float]:
    """The chance that a candidate of each kind and pattern is personal data, by expectation-maximisation.

    Every labeler has a rate for each vote under either class; classes have a prior by kind. The start takes votes
    for what they say, and a vote never comes to speak against what it says.
    """
    patterns = sorted(counts)
    rate = [[{-1: 0.1, 0: 0.3, 1: 0.6}, {-1: 0.6, 0: 0.3, 1: 0.1}] for _ in LABELERS]
    prior = {k.name: 0.7 for k in KINDS}
    posterior: dict[tuple[str, int], float] = {}
    for _ in range(rounds):
        for key in patterns:
            odds = math.log(prior[key[0]] / (1 - prior[key[0]]))
            odds += sum(math.log(r[0][v] / r[1][v]) for r, v in zip(rate, _unpack(key[1]), strict=True))
            posterior[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for j in range(len(LABELERS)):
            for side in (0, 1):
                sums = {-1: 1.0, 0: 1.0, 1: 1.0}
                for key in patterns:
                    sums[_unpack(key[1])[j]] += counts[key] * abs(side - posterior[key])
                rate[j][side] = {v: x / sum(sums.values()) for v, x in sums.items()}
            for v, better, worse in ((1, 0, 1), (-1, 1, 0)):
                if rate[j][better][v] < rate[j][worse][v]:
                    rate[j][better][v] = rate[j][worse][v]
        for name in prior:
            own = [k for k in patterns if k[0] == name]
            total = sum(counts[k] for k in own)
            prior[name] = (7 + sum(counts[k] * posterior[k] for k in own)) / (10 + total)
    return posterior


def fit(counts: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """The classifier's probability for each kind and pattern, from the counts of patterns: a logistic model of votes, kind
    and form, fitted to the posteriors, weighted by counts."""
    names = [k.name for k in KINDS]
    posterior = posteriors(counts)
    patterns = sorted(counts)

    def row(key: tuple[str, int]) -> list[float]:
        form = key[1] % FORMS
        ones = [float(form // 4 == i) for i in range(4)] + [float(form % 4 == i) for i in range(4)]
        return [1.0, *map(float, _unpack(key[1])), *(float(n == key[0]) for n in names), *ones]

    weights = [0.0] + [1.0] * len(LABELERS) + [0.0] * (len(names) + 8)
    rows = [(row(k), counts[k], posterior[k]) for k in patterns]
    total = sum(counts.values()) or 1
    for _ in range(300 if patterns else 0):
        step = [0.01 * w for w in weights]
        for x, n, target in rows:
            p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x, strict=True))))
            for i, v in enumerate(x):
                step[i] += n / total * (p - target) * v
        weights = [w - 0.5 * s for w, s in zip(weights, step, strict=True)]
    score = lambda key: 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, row(key), strict=True))))
    return {(n, v): score((n, v)) for n in names for v in range(27 * FORMS)}


def find(docs: DataFrame, *, text="text", doc_id="doc_id", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_<kind> of base kinds, base (array of kind:start:end), spans (the same with further ones)."""
    found = candidates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")

    def named(kind: Kind) -> Column:
        return F.transform(f"_{kind.name}", lambda s: F.struct(F.lit(kind.name).alias("kind"), s["votes"].alias("votes")))

    every = F.concat(*map(named, KINDS))
    voted = found.select(F.explode(every).alias("x")).groupBy("x.kind", "x.votes").count()
    base = [k for k in KINDS if k.base]
    belief = fit({(r["kind"], r["votes"]): r["count"] for r in voted.collect()})

    def spelt(kind: Kind) -> Column:
        spans = F.col(f"_{kind.name}")
        if not kind.base:
            good = [v for v in range(27 * FORMS) if belief[kind.name, v] >= threshold]
            # A further span never overlaps a base one.
            spans = F.filter(spans, lambda s: s["votes"].isin(good) & ~_overlaps(s))
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind.name), s["a"].cast("string"), s["b"].cast("string")))

    def _meets(spans: str, s: Column) -> Column:
        """Whether s meets one of the spans: the last that starts before its end, found by halving."""
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int") + 1)

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            before = (acc["low"] < acc["high"]) & F.coalesce(F.get(spans, mid)["a"] < s["b"], F.lit(False))
            return F.struct(F.when(before, mid + 1).otherwise(acc["low"]).alias("low"), F.when(before, acc["high"]).otherwise(mid).alias("high"))

        start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
        last = F.aggregate(steps, start, halve, lambda acc: acc["low"])
        return F.coalesce(F.get(spans, last - 1)["b"] > s["a"], F.lit(False))

    def _overlaps(s: Column) -> Column:
        hit = F.lit(False)
        for k in base:
            hit = hit | _meets(f"_{k.name}", s)
        return hit

    return found.select(
        "doc_id",
        *[F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in base],
        F.concat(*map(spelt, base)).alias("base"),
        F.concat(*map(spelt, KINDS)).alias("spans"),
    )
