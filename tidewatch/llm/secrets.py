"""Secret scan: fixed patterns, then character Markov models; DataFrame operations only.

Two first-order character models are counted over labelled samples. Random strings are
what the fixed patterns caught in the whole corpus, and uniform strings over the
alphabets in which secrets are written; each of these sources weighs alike, so a corpus
full of one kind does not hide the others. Ordinary identifiers are neighbouring words
of a bounded sample of texts, joined in the usual ways.

A long token that no pattern has caught is a secret if the log-likelihood ratio, summed
over its character pairs, exceeds the prior odds against it. So the mean ratio that is
asked for falls with the length. The ratio table has one number for each pair of a fixed
alphabet and travels as a literal; texts are neither shuffled nor written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Fixed patterns of the base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Shorter runs never pass and hold no longer one, so the length is part of the pattern.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Tokens that are samples or candidates; long pieces that dots join are one, such as signed web tokens.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]{16,})*"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
OTHER = len(ALPHABET)
SIZE = OTHER + 1
_UPPER, _LOWER, _DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: Alphabets of random samples.
RANDOM = {
    "hex": _DIGITS + "abcdef",
    "upper hex": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "capitals and digits": _UPPER + _DIGITS,
    "small letters and digits": _LOWER + _DIGITS,
    "letters and digits": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64 for urls": _UPPER + _LOWER + _DIGITS + "-_",
    "letters": _UPPER + _LOWER,
    "small letters": _LOWER,
    "capitals": _UPPER,
}
# Training labels: words of which identifiers are made, in English and other languages, and abbreviations. No corpus is needed for them.
PARTS = (
    "access account action active adapter address agent alert android angular apache application archive array async audio backup batch binary block boolean bridge browser buffer builder button cache "
    "calendar callback cancel capture channel character checkout checksum client cluster collection column command comment commit common complete component condition config connection console constant "
    "container content context control convert counter country create credential currency current custom database decode default delete delivery deploy descriptor destination detail dialog digest directory "
    "display distance document domain download driver dynamic editor element encode engine environment error event exception exchange execute expression external failure feature filter folder format "
    "fragment framework function gateway generator global graph handler hardware header height helper history identity image import index inner input instance integer interface internal invoice iterator"
)
FOREIGN = "straße verwaltung rechnung kunden benutzer uebersicht schluessel przyklad wartosc uzytkownik szczegoly wszystkie dziennik fichier utilisateur paiement adresse bibliotheque nombre usuario contraseña pedido factura".replace("ß", "ss").replace("ñ", "n")
SHORT = "AES API ASCII AWS CPU CSS CSV DB DNS DTO EC2 FTP GPU GUI H264 HTML HTTP HTTPS I18N ID IO IPV4 IPV6 JDBC JPEG JSON JWT K8S LDAP MD5 MP4 OAUTH2 OS PDF PNG RPC RSA S3 SDK SHA1 SHA512 SQL SSH SSL TCP TLS UDP UI URI URL UTF8 UUID VM WIFI X509 XHTML XML XSS"
#: Words of ordinary identifiers: letters alone between characters that end a token.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,15}(?![A-Za-z0-9+/_=-])"


def _spans(text: Column, pattern: str, *, maybe: Column, least: int = 0, group: int = 0) -> Column:
    """Matches as array of (start, end, value): leftmost, in code points; ``maybe`` spares texts a search.

    The places follow from the lengths of the matches and of what lies between them.
    Matches whose value has under ``least`` characters are left out.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.char_length(part["gap"])
        end = begin + F.coalesce(F.char_length(part["hit"]), F.lit(0))
        one = F.struct(begin.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(part["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(one))).alias("found"))

    found = F.aggregate(parts, start, step, lambda a: a["found"])
    long_enough = F.filter(found, lambda s: F.char_length(s["value"]) >= least) if least else found
    return F.when(maybe, long_enough).otherwise(none)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, assign, access, hex, tokens): spans with their values, one row for each row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lower = F.lower(body)
    keyword = F.lit(False)
    for word in ("passw", "secret", "token", "api"):
        keyword = keyword | F.contains(lower, F.lit(word))
    return docs.select(
        F.col(doc_id).alias("doc"),
        _spans(body, ASSIGN, maybe=keyword, least=6, group=2).alias("assign"),
        _spans(body, ACCESS, maybe=F.contains(body, F.lit("AKIA")), least=20).alias("access"),
        _spans(body, HEX, maybe=F.rlike(body, F.lit(HEX))).alias("hex"),
        _spans(body, TOKEN, maybe=F.rlike(body, F.lit(TOKEN))).alias("tokens"),
    )


def random_strings(spark: SparkSession, strings: int = 2000, length: int = 32) -> DataFrame:
    """(source, value): uniform strings over every alphabet of ``RANDOM``, the same at each call."""
    alphabets = F.array(*(F.struct(F.lit(name).alias("source"), F.lit(letters).alias("letters")) for name, letters in RANDOM.items()))
    rows = spark.range(strings).select("id", F.explode(alphabets).alias("a")).select("id", "a.source", "a.letters")

    def letter(j: Column) -> Column:
        return F.substr(F.col("letters"), F.pmod(F.xxhash64("id", "source", j), F.char_length("letters")).cast("int") + 1, F.lit(1))

    return rows.select("source", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "").alias("value"))


def caught_values(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(source, value): distinct values that the fixed patterns catch in all of ``docs``."""
    caught = scan(docs, doc_id, text).select(F.explode(F.concat("assign", "access", "hex")).alias("s"))
    return caught.select(F.lit("caught").alias("source"), F.col("s.value").alias("value")).distinct()


def ordinary_identifiers(docs: DataFrame, doc_id: str, text: str, max_texts: int = 500) -> DataFrame:
    """(source, value): identifiers made of neighbouring words of ``max_texts`` different texts, the least by hash.

    Words are joined by underscores, hyphens, slashes or capitals, with and without
    numbers; plain numbers and rows of one character are ordinary too.
    """
    h = F.xxhash64(F.col(text))
    few = docs.where(F.col(text).isNotNull()).groupBy(h.alias("h")).agg(F.min(doc_id).alias("one")).orderBy("h").limit(max_texts)
    texts = docs.select(h.alias("h"), F.col(doc_id).alias("one"), F.col(text).alias("body")).join(F.broadcast(few), ["h", "one"]).dropDuplicates(["h"])
    texts = texts.select("h", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)).alias("w"))

    def made(i: Column) -> Column:
        a, b, c = (F.element_at("w", i + k) for k in range(3))
        dice = F.xxhash64("h", i)
        number = F.lpad(F.abs(dice).cast("string"), F.pmod(dice, F.lit(3)).cast("int") + 2, "0")
        digits = F.lpad(F.abs(dice).cast("string"), 18, "0")
        kinds = {
            "snake": F.lower(F.concat_ws("_", a, b, c)),
            "constant": F.upper(F.concat_ws("_", a, b, c)),
            "kebab": F.lower(F.concat_ws("-", a, b, c)),
            "path": F.concat(F.lit("/"), F.lower(F.concat_ws("/", a, b, c)), F.lit("/")),
            "camel": F.concat(F.lower(a), F.initcap(b), F.initcap(c)),
            "words": F.concat(a, F.lower(b), F.lower(c)),
            "upper words": F.upper(F.concat(a, b)),
            "numbered": F.concat(F.lower(F.concat_ws("_", a, b)), F.lit("_"), number),
            "numbered camel": F.concat(F.initcap(a), F.initcap(b), number),
            "dated": F.concat(F.lower(a), F.lit("-20"), F.substr(digits, F.lit(1), F.lit(2)), F.lit("-"), F.substr(digits, F.lit(3), F.lit(2)), F.lit("-"), F.lower(b)),
            "number": digits,
            "line": F.repeat(F.element_at(F.array(*map(F.lit, "-=_/+")), F.pmod(dice, F.lit(5)).cast("int") + 1), F.lit(18)),
        }
        pick, out = F.pmod(F.shiftright(dice, 8), F.lit(len(kinds))), None
        for k, (name, value) in enumerate(kinds.items()):
            one = F.struct(F.lit(name).alias("source"), value.alias("value"))
            out = F.when(pick == k, one) if out is None else out.when(pick == k, one)
        return out

    places = F.when(F.size("w") > 2, F.sequence(F.lit(1), F.size("w") - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
    return texts.select(F.explode(F.transform(places, made)).alias("s")).select("s.source", "s.value")


def known_identifiers(spark: SparkSession, names: int = 20_000) -> DataFrame:
    """(source, value): identifiers made of ``PARTS``, ``FOREIGN`` and ``SHORT``, the same at each call.

    Two to four words are joined in the ways of programming languages, file names and
    protocols, with abbreviations, numbers and rows of capitals at any place.
    """
    draw = lambda *salt: F.xxhash64("id", *map(F.lit, salt))
    listed = lambda words: F.split(F.lit(words), " ")
    pick = lambda words, salt: F.get(listed(words), F.pmod(draw(salt), F.lit(len(words.split()))).cast("int"))
    word = lambda i: F.when(F.pmod(draw(f"f{i}"), F.lit(6)) == 0, pick(FOREIGN, f"w{i}")).otherwise(pick(PARTS, f"w{i}"))
    # drawn in a projection of their own, so that the shapes below refer to columns
    drawn = spark.range(names).select(
        *(word(i).alias(c) for i, c in enumerate("abcd")), pick(SHORT, "s").alias("short"), F.abs(F.pmod(draw("n"), F.lit(1000))).cast("string").alias("number"),
        (F.pmod(draw("more"), F.lit(2)) == 0).alias("more"), F.pmod(draw("shape"), F.lit(24)).cast("int").alias("shape"),
    )
    a, b, c, d, short, number = map(F.col, ("a", "b", "c", "d", "short", "number"))
    up, more = F.initcap, lambda x: F.when(F.col("more"), x).otherwise("")
    shapes = (
        F.concat(a, up(b), up(c), more(up(d))), F.concat(up(a), up(b), up(c), more(up(d))), F.concat(F.lower(F.substr(short, F.lit(1), F.lit(2))), up(a), up(b), up(c)),
        F.concat(short, up(a), up(b), more(up(c))), F.concat(up(a), short, up(b), up(c)), F.concat(up(a), up(b), short), F.concat(short, a, F.substr(short, F.lit(1), F.lit(3)), up(b), number),
        F.concat_ws("_", a, b, c), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("_", short, F.upper(a), F.upper(b)), F.concat_ws("_", up(a), up(b), c), F.concat(F.concat_ws("_", a, b), number), F.concat(F.lit("__"), a, F.lit("_"), b, F.lit("__")),
        F.concat_ws("-", a, b, c), F.concat_ws("-", up(a), up(b), up(c)), F.concat_ws("-", F.lower(short), a, number, b), F.concat_ws("/", a, b, F.lower(short), c), F.concat_ws("/", a, F.concat_ws("-", b, number), c), F.concat_ws("/", up(a), F.concat(b, F.lit("_"), c)),
        F.concat(a, b, c), F.upper(F.concat(a, b, c)), F.concat(a, F.lit("="), b, F.lit("_"), c, number), F.concat_ws("+", a, b, c), F.concat(a, number, up(b), number, up(c)),
    )
    chosen = [F.when(F.col("shape") == i, shape) for i, shape in enumerate(shapes)]
    return drawn.select(F.lit("known").alias("source"), F.coalesce(*chosen).alias("value"))


def labelled_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", strings: int = 2000, max_texts: int = 500) -> DataFrame:
    """(secret, source, value): random strings and ordinary identifiers."""
    secret = random_strings(docs.sparkSession, strings).unionByName(caught_values(docs, doc_id, text))
    plain = ordinary_identifiers(docs, doc_id, text, max_texts).unionByName(known_identifiers(docs.sparkSession))
    return secret.withColumn("secret", F.lit(True)).unionByName(plain.withColumn("secret", F.lit(False)))


def pair_codes(value: Column) -> Column:
    """Array with the number of each pair of neighbouring characters."""
    codes = F.transform(F.split(value, ""), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(ALPHABET)), F.lit(0)) - 1, F.lit(OTHER)))
    pairs = F.char_length(value) - 1
    return F.zip_with(F.slice(codes, F.lit(1), pairs), F.slice(codes, F.lit(2), pairs), lambda a, b: a * SIZE + b)


def train(samples: DataFrame, weight: float = 100_000.0, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every pair: random strings against ordinary identifiers.

    Counts are taken over all of ``samples(secret, source, value)``; those of random
    sources are scaled to ``weight`` pairs each. A row for each pair that occurs, ``SIZE * SIZE``
    at most, reaches the driver, whatever the corpus.
    """
    pairs = samples.where(F.char_length("value") > 1).select("secret", "source", F.explode(pair_codes(F.col("value"))).alias("pair"))
    counted = pairs.groupBy("secret", "source", "pair").agg(F.count("*").alias("n"))
    # a window over the few pairs of a source, not a join of the counts with their own sums, which would plan and run all of the sampling again
    whole = F.sum("n").over(Window.partitionBy("secret", "source"))
    scaled = counted.select("secret", "pair", F.when(F.col("secret"), F.col("n") * weight / whole).otherwise(F.col("n")).alias("n"))
    rows = scaled.groupBy("pair").agg(F.sum(F.when(F.col("secret"), F.col("n"))).alias("random"), F.sum(F.when(~F.col("secret"), F.col("n"))).alias("plain")).collect()
    random, plain = [0.0] * (SIZE * SIZE), [0.0] * (SIZE * SIZE)
    for row in rows:
        random[row.pair], plain[row.pair] = row.random or 0.0, row.plain or 0.0

    def likelihoods(counts: list[float]) -> list[float]:
        """Logarithm of the smoothed probability of every pair, given its first character."""
        after = [sum(counts[i : i + SIZE]) for i in range(0, SIZE * SIZE, SIZE)]
        return [math.log((n + smoothing) / (after[p // SIZE] + smoothing * SIZE)) for p, n in enumerate(counts)]

    return [r - p for r, p in zip(likelihoods(random), likelihoods(plain))]


def ratio_of(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of ``value``, summed over its character pairs."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded to a constant
    return F.aggregate(pair_codes(value), F.lit(0.0), lambda a, p: a + F.element_at(ratios, p + 1))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float = 10.0, strings: int = 2000, max_texts: int = 500) -> DataFrame:
    """(doc, spans): one row for each row of ``docs``; spans of (start, kind, end, value), sorted.

    ``kind`` counts from 0 along ``KINDS``. The first three are the fixed patterns. A
    ``random`` span is a token of 16 characters or more, apart from all of those, whose
    log-likelihood ratio is at least ``prior``, the logarithm of the odds against a secret.
    The model is fitted on ``strings`` random strings an alphabet, all values that the
    patterns catch, and the words of ``max_texts`` texts.

    Defined cases: a null text is empty; a text of any length is searched whole;
    repeated rows are scanned alike, and texts and values count once in the models;
    without words to learn from every pair is as likely in identifiers, so the random
    model alone decides; an empty table stays empty; extra columns are ignored.
    """
    table = train(labelled_samples(docs, doc_id, text, strings, max_texts))
    scanned = scan(docs, doc_id, text)
    base = F.concat("assign", "access", "hex")
    apart = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    random = F.filter(apart, lambda t: ratio_of(t["value"], table) >= prior)

    def named(spans: Column | str, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    kinds = [named(c, k) for k, c in enumerate(("assign", "access", "hex", random))]
    return scanned.select("doc", F.array_sort(F.concat(*kinds)).alias("spans"))


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """(doc, text): each text with its secrets masked; overlapping spans are masked as one.

    The texts ride along with the ids through the scan, so rows that repeat an id keep
    their own. Defined cases are those of ``find_secrets``; a null text stays null.
    """
    row = F.struct(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    found = find_secrets(docs.select(row.alias("row"), F.col(text).alias("body")), "row", "body", **options)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        between = F.substr(F.col("body"), acc["at"] + 1, span["start"] - acc["at"])
        joined = F.when(span["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), joined.alias("out"))

    folded = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr(F.col("body"), a["at"] + 1)))
    return found.select(F.col("doc.id").alias("doc"), F.col("doc.body").alias("body"), "spans").select("doc", folded.alias("text"))
