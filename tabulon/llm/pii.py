"""Personal information inside free text (problem 9): bootstrapped contextual extraction.

Each text yields candidate spans of wide shapes: mail addresses, numbers, number-like codes, street addresses and runs
of capitalised words or Han characters. A candidate has an *instance* (the shape of a number, the street of an address,
the words of a name) and *patterns* (the tokens left of it, right of it, and both). Seeds are occurrences whose kind is
plain: a country code, a label such as a social security number's, a town behind a street, a word of the contact
directory. Seeds score patterns, patterns score instances, instances score patterns again, over several rounds of
grouped sums in Spark; occurrences whose instance and patterns score high are accepted, seeds and unseen ones alike.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.skew import heavy_keys, join_unique
from tabulon.session import table
from tabulon.workspace import Workspace

ROUNDS = 3
#: Pseudo-occurrences without the kind that every pattern, and every instance, starts with.
DOUBT = 0.5

_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|point)\s?[\])}>]\s?| dot )"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9À-ÿ_](?:[A-Za-z0-9À-ÿ._%+'-]*[A-Za-z0-9À-ÿ_+-])?"
MAIL = re.compile(
    rf"(?:{_LOCAL}(?:(?:\s?[\[(]dot[\])]\s?| dot ){_LOCAL})*)(?:(?:@|＠|\s?[\[({{<]\s?(?:at|ät|arobase|@)\s?[\])}}>]\s?){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}| at {_LABEL}(?:{_DOT}{_LABEL})*(?: dot |\s?[\[(]dot[\])]\s?)[A-Za-z]{{2,}}(?:{_DOT}[A-Za-z]{{2,}})*)(?![A-Za-z0-9]|-\w)",
)
#: What every mail address has; texts without it aren't searched further.
_MAIL_SIGN = re.compile(r"[@＠]|[\[({<]\s?(?:at|ät|arobase)\s?[\])}>]| at [A-Za-z0-9.-]+\s?(?: dot |[\[(]\s?dot)")
NUMBER = re.compile(r"(?<![A-Za-z0-9_.\-–/])(?<!\d:)(?:\(\+?\d{1,4}\)\s?|\+)?\d+(?:(?:[ \-.]?\(\d{1,4}\)[ \-.]?|[ .\-/–])?\d+)*(?:X(?![A-Za-z0-9]))?(?![A-Za-z0-9_]|[.,:/]\d)")
CODE = re.compile(r"(?<![A-Za-z0-9_\-./])(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{7,14}(?![A-Za-z0-9_\-])")
#: Words that announce an identity number.
ID_LABEL = re.compile(
    r"(?i)(?:\bssn|social security (?:no\.?|number)|\btax id|passport(?: no\.?| number)?|passeport|reisepass(?: ?nr\.?)?|orcid(?: id)?|researcher id|steuer-?id|\bidnr\.?|personalausweis(?: ?nr\.?)?|ausweis(?: ?nr\.?)?|n° de sécurité sociale|sécurité sociale|\bnir|numéro insee|身份证号码?|身份证|证件号码?|护照号?码?)\s?[:：=]?\s?$"
)
_EN_TYPE = r"(?:Street|St|Road|Rd|Lane|Ln|Close|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Way|Place|Court|Terrace|Crescent|Row|Square)"
_FLAT = r"(?:Flat|Apt|Apartment|Unit|Suite)\.? ?\d+[A-Za-z]?"
STREETS = [
    re.compile(rf"(?<![A-Za-z0-9À-ÿ.-])(?:{_FLAT}, )?\d+[A-Za-z]? (?:[NSEW]\.? )?(?P<s>[A-Z][\w'’-]+(?: [A-Z][\w'’-]+)? {_EN_TYPE})\b(?:(?<=Blvd)\.)?(?:, {_FLAT})?"),
    re.compile(r"(?<![A-Za-z0-9À-ÿ.-])(?P<s>(?:(?:Am|An der|An den|Im|In der|In den|Auf der|Auf dem|Zum|Zur|Hinter der|Unter den) )?(?:[A-ZÄÖÜ][a-zäöüß]+-)*[A-ZÄÖÜ][A-Za-zäöüÄÖÜß]*(?:straße|strasse|str\.|weg|allee|graben|gasse|platz|ufer|ring|steig|damm|markt|chaussee|stieg|pfad)|(?:[A-ZÄÖÜ][a-zäöüß]+-)+(?:Straße|Str\.|Weg|Allee|Graben|Gasse|Platz|Ufer|Ring|Steig|Damm)|(?:Am|An der|Im|In der|Auf der|Zum|Zur) [A-ZÄÖÜ][a-zäöüß-]+) \d+ ?[a-z]?(?![\w.]\w)(?![a-zäöü])(?:(?:,| /|/) ?(?:Whg\.?|Wohnung|App\.?|Apartment) ?\d+)?"),
    re.compile(r"(?<![A-Za-z0-9À-ÿ.-])\d+(?: ?(?:bis|ter|quater)\b)?,? (?P<s>(?:rue|chemin|bd|boulevard|avenue|av\.|impasse|place|allée|quai|route|cours|square|passage) (?:de la |de l['’]|du |des |de |d['’])?[A-ZÉÈÀÎÂ][\w'’]*(?:[ -](?:[A-ZÉÈÀÎÂ][\w'’]*|de|la|du|des|en|sur))*)(?:, (?:appt?|appartement|apt|bât)\.? ?\w+)*"),
    re.compile(r"(?P<s>[一-鿿]{2}(?:大道|路|街|巷|胡同))\d+(?:弄\d+号|号|弄)(?:\d+(?:栋|幢|号楼|座))?(?:\d+单元)?(?:\d+(?:室|房|户))?"),
]
#: A house number and capitalised words before a town: a street of any type, for the graph to judge.
ANY_STREET = re.compile(r"(?<![A-Za-z0-9À-ÿ.-])\d+[A-Za-z]? (?P<s>[A-Z][\w'’-]+(?: [A-Z][\w'’-]+){1,2})(?=,? ?(?:\d{5} [A-ZÄÖÜÉ]|[A-Z][a-z]+ [A-Z]{2}\d))")
#: Forms of address and openings that are no part of a name.
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Professor Herr Herrn Frau Mme Mlle Monsieur Madame Dear Hi Hello Hallo Bonjour Liebe Lieber Cher Chère Thanks Merci Danke Thank Dipl Ing Ph Viele Beste Liebe Grüße Grüßen Best Kind Regards Cordialement From To Cc Subject Re".split())
_WORD = r"(?:[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+)(?:['’-][A-ZÀ-Þ][A-Za-zß-öø-ÿ]+)*)"
RUN = re.compile(rf"(?<![A-Za-z0-9_@À-ÿ.\-/]){_WORD}(?![a-z0-9À-ÿ_/@])(?:(?: (?:[A-Z]\. ?)*|, ){_WORD}(?![A-Za-z0-9À-ÿ_/@]))*(?: [A-Z]\.(?![A-Za-z]))?|(?<![A-Za-z0-9_.]){{0}}(?<![A-Za-z0-9_.\-])(?:[A-Z]\. ?)+{_WORD}(?![A-Za-z0-9À-ÿ_/@])(?: {_WORD}(?![A-Za-z0-9À-ÿ_/@]))*")
_PART = re.compile(rf"{_WORD}|[A-Z]\.|,")
#: What surrounds a word of running text; other signs inside make it none.
_EDGES = ".,;:!?()[]{}<>\"'«»„“”‚’…*/"
_FRENCH = re.compile(r"(?i)\b(?:selon|la|le|les|des|est|hier)\b")
#: Characters before a number that a label of an identity number and the signs behind it take at most.
LABEL_REACH = 32
_TOWN = re.compile(r",? ?(?:\d{5} [A-ZÄÖÜÉ]|[A-Z][a-z]+(?: [A-Z][a-z]+)* (?:\d{5}|[A-Z]{2}\d))")
_HAN, _HAN_RUN = re.compile(r"[一-鿿]"), re.compile(r"[一-鿿]{2,}")
#: Score from which a pattern may propose spans of its own, and how many such patterns are sent to the workers; more are met by joins.
SURE, PROPOSERS = 0.8, 2000


def _norm(token: str) -> str:
    return "9" if token.isdigit() else token.lower() if len(token) < 40 else "long"


_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_|\n", re.UNICODE)


class Tokens:
    """The tokens of a text with their places; line ends are tokens, over which no pattern reaches."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words, self.starts = [], []
        for m in _TOKEN.finditer(text):
            self.words.append(m.group())
            self.starts.append(m.start())

    def around(self, start: int, end: int) -> tuple[str, str, str]:
        """Left, right and joint pattern of a span: two tokens on each side within its line."""
        i, j, words = bisect_left(self.starts, start), bisect_left(self.starts, end), self.words
        left, right = [], []
        for k in (i - 1, i - 2):
            if k < 0 or words[k] == "\n":
                break
            left.insert(0, _norm(words[k]))
        for k in (j, j + 1):
            if k >= len(words) or words[k] == "\n":
                break
            right.append(_norm(words[k]))
        return _named(left, right)


def _named(left: list[str], right: list[str]) -> tuple[str, str, str]:
    left, right = left or ["^"], right or ["$"]
    return "L " + " ".join(left), "R " + " ".join(right), "B " + left[-1] + " _ " + right[0]


def _han_patterns(text: str, start: int, end: int) -> tuple[str, str, str]:
    """As Tokens.around, with two characters on each side, as Han text has no words."""
    a, b = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    left = re.sub(r"\d", "9", text[a:start].rstrip(" ")[-2:])
    right = re.sub(r"\d", "9", text[end : b if b >= 0 else len(text)].lstrip(" ")[:2])
    return _named([left] if left else [], [right] if right else [])


def _lines_with(text: str, sign: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end of each line that has the sign."""
    done = -1
    for m in sign.finditer(text):
        if m.start() < done:
            continue
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        done = b if b >= 0 else len(text)
        yield a, done


def _shape(number: str) -> str:
    return re.sub(r"\d", "9", number)


class Finder:
    """Candidate spans of one text. names: words of the directory; families and givens: its Han names."""

    def __init__(self, names: set[str], families: set[str], givens: set[str]) -> None:
        self.names, self.families, self.givens = names, families, givens
        first = "".join(re.escape(f[0]) for f in sorted(families)) or "\0"
        self.han_start = re.compile(f"[{first}]")

    def spans(self, text: str) -> Iterator[tuple]:
        """(kind, start, end, instance, seed, left, right, both)"""
        taken = bytearray(len(text))

        def claim(a: int, b: int) -> bool:
            if any(taken[a:b]):
                return False
            taken[a:b] = b"\1" * (b - a)
            return True

        tokens = Tokens(text)
        for a, b in _lines_with(text, _MAIL_SIGN):
            for m in MAIL.finditer(text, a, b):
                if claim(*m.span()):
                    yield "email", *m.span(), "", 1, "", "", ""
        for street in STREETS:
            for m in street.finditer(text):
                if any(taken[m.start() : m.end()]):
                    continue
                town = _TOWN.match(text, m.end())
                claim(*m.span())
                name = m.group("s")
                yield "address", *m.span(), name.lower(), int(bool(town) or bool(_HAN.search(name))), *tokens.around(*m.span())
        for m in ANY_STREET.finditer(text):
            if claim(*m.span()):
                yield "address", *m.span(), m.group("s").lower(), 0, *tokens.around(*m.span())
        for form in (CODE, NUMBER):
            for m in form.finditer(text):
                digits = sum(c.isdigit() for c in m.group())
                if (form is NUMBER and not 7 <= digits <= 24) or any(taken[m.start() : m.end()]):
                    continue
                claim(*m.span())
                label = bool(ID_LABEL.search(text[max(0, m.start() - LABEL_REACH) : m.start()].replace("\n", "|")))
                plus = m.group().startswith(("+", "(+"))
                shape = _shape(m.group()) if form is NUMBER else ("AA9999999" if re.fullmatch(r"[A-Z]{2}\d{7}", m.group()) else f"code{len(m.group())}")
                yield "number", *m.span(), shape, 2 if label else 1 if plus else 0, *tokens.around(*m.span())
        for m in RUN.finditer(text):
            run = m.group()
            if run.isalpha():  # one word
                if not any(taken[m.start() : m.end()]) and run not in TITLES:
                    low = run.lower()
                    known = low in self.names
                    yield "name", m.start(), m.end(), f"*{low}" if known else low, int(known), *tokens.around(m.start(), m.end())
            else:
                yield from self._latin(text, m.start(), m.end(), taken, tokens)
        if _HAN.search(text):
            yield from self._han(text, taken)

    def _latin(self, text: str, start: int, end: int, taken: bytearray, tokens: Tokens) -> Iterator[tuple]:
        """A run of words, cut at titles and at claimed text; a comma inside is kept only between two single parts."""
        parts, current = [], []
        for w in _PART.finditer(text, start, end):
            a, b = w.span()
            word = w.group()
            if any(taken[a:b]) or word in TITLES:
                parts.append(current)
                current = []
            else:
                current.append((a, b, word))
        parts.append(current)
        for part in parts:
            while part and part[0][2] == ",":
                part = part[1:]
            while part and part[-1][2] == ",":
                part = part[:-1]
            commas = [i for i, p in enumerate(part) if p[2] == ","]
            pieces = [part]
            if commas and not (len(commas) == 1 and commas[0] == 1 and len(part) in (3, 4)):
                pieces, last = [], 0
                for i in [*commas, len(part)]:
                    pieces.append(part[last:i])
                    last = i + 1
            for piece in pieces:
                if len(piece) > 1 and piece[0][2] == "M." and (re.fullmatch(r"[A-Z]\.", piece[1][2]) or len(piece) > 2 or _FRENCH.search(text[max(0, start - 12) : end + 40].split("\n")[0] if "\n" not in text[max(0, start - 12) : start] else text[start : end + 40].split("\n")[0])):
                    piece = piece[1:]  # Monsieur
                words = [p[2] for p in piece if p[2] != "," and not re.fullmatch(r"[A-Z]\.", p[2])]
                if not words:
                    continue
                parts_of = [x.lower() for w in words for x in re.split(r"['’-]", w)]
                key = " ".join(f"*{x}" if x in self.names else x for x in parts_of)  # words of the directory are marked
                yield "name", piece[0][0], piece[-1][1], key, int(all(x in self.names for x in parts_of)), *tokens.around(piece[0][0], piece[-1][1])

    def _han(self, text: str, taken: bytearray) -> Iterator[tuple]:
        used = 0
        for m in self.han_start.finditer(text):
            i = m.start()
            if i < used or taken[i]:
                continue
            for k in (2, 1):
                given = text[i + 1 : i + 1 + k]
                if given in self.givens and text[i] in self.families:
                    used = i + 1 + k
                    yield "name", i, used, "*" + text[i:used], 1, *_han_patterns(text, i, used)
                    break
            else:
                for k in (2, 1):
                    given = text[i + 1 : i + 1 + k]
                    if len(given) == k and all(_HAN.match(c) for c in given):
                        yield "name", i, i + 1 + k, text[i : i + 1 + k], 0, *_han_patterns(text, i, i + 1 + k)
        for given in self.givens:
            for m in re.finditer(re.escape(given), text) if len(given) > 1 else ():
                a, b = m.span()
                if a and text[a - 1] in self.families or any(taken[a:b]):
                    continue
                yield "name", a, b, given, 0, *_han_patterns(text, a, b)
                if a and _HAN.match(text[a - 1]):
                    yield "name", a - 1, b, text[a - 1 : b], 0, *_han_patterns(text, a - 1, b)


def directory_words(rows: list) -> tuple[set[str], set[str], set[str]]:
    """Latin words in lower case, Han family names, Han given names."""
    names, families, givens = set(), set(), set()
    for given, family in rows:
        for value, han in ((given, givens), (family, families)):
            if value and _HAN.search(value):
                han.add(value.strip())
            elif value:
                names.update(x for x in re.split(r"[\s'’-]+", value.lower()) if x)
    return names, families, givens


SPANS = "doc_id bigint, kind string, start int, stop int, mention string, instance string, seed int, l string, r string, b string"


def candidate_spans(spark: SparkSession, documents: DataFrame, directory: list) -> DataFrame:
    """Candidates of all texts, and rows of kind ``vocab``: words seen in lower case, with their number as ``seed``."""
    names, families, givens = directory_words(directory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(names, families, givens)
        for pdf in batches:
            out, lower = [], Counter()
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                out.extend((doc, k, a, b, text[a:b], i, s, le, ri, bo) for k, a, b, i, s, le, ri, bo in finder.spans(text))
                words = {w.strip(_EDGES) for w in set(text.split())}
                lower.update(w for w in words if len(w) > 1 and w.islower() and w.isalpha() and w < "ɐ")
            out.extend((-1, "vocab", 0, 0, "", w, n, "", "", "") for w, n in lower.items())
            yield pd.DataFrame(out, columns=["doc_id", "kind", "start", "stop", "mention", "instance", "seed", "l", "r", "b"])

    return documents.where("text IS NOT NULL AND text != ''").select("doc_id", "text").mapInPandas(run, SPANS)


def scored_graph(ws: Workspace, pairs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of instances (class, instance) and patterns (class, pattern) from pairs (class, instance, pattern, n, seeds, bad).

    A pattern scores the mean over its occurrences: 1 for seeds, else the score of their instance; an instance the mean
    score of its patterns, 0 if it is known to be common (bad); both with DOUBT occurrences of score 0. At first an
    instance scores its own share of seeds. Both tables are grouped sums, so hot patterns are combined before the shuffle.
    """
    own = pairs.groupBy("class", "instance").agg(F.sum("seeds").alias("s"), F.sum("n").alias("n"), F.max("bad").alias("bad"))
    score = ws.stage(own.select("class", "instance", F.when(F.col("bad") == 1, 0.0).otherwise(F.col("s") / (F.col("n") + DOUBT)).alias("score")))
    for _ in range(rounds):
        met = pairs.join(score, ["class", "instance"])
        value = F.col("seeds") + (F.col("n") - F.col("seeds")) * F.col("score")
        patterns = ws.stage(met.groupBy("class", "pattern").agg((F.sum(value) / (F.sum("n") + DOUBT)).alias("p")))
        back = pairs.join(patterns, ["class", "pattern"]).groupBy("class", "instance").agg(
            F.max("bad").alias("bad"), (F.sum(F.col("seeds") + (F.col("n") - F.col("seeds")) * F.col("p")) / (F.sum("n") + DOUBT)).alias("m")
        )
        after = ws.stage(back.select("class", "instance", F.when(F.col("bad") == 1, 0.0).otherwise(F.col("m")).alias("score")))
        ws.drop(score)
        score = after
    return score, patterns


def scored_spans(ws: Workspace, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates but mail, in each class they may have, with the scores of their instance (s, low) and context; and the
    patterns (class, pattern, p) with their number n."""
    common = ws.stage(spans.where("kind = 'vocab'").groupBy("instance").agg(F.sum("seed").alias("lower")).where("lower >= 2").select(F.col("instance").alias("word")))
    open_spans = spans.where("kind NOT IN ('email', 'vocab')")
    classes = F.when(F.col("kind") == "number", F.array(F.lit("phone"), F.lit("id_number"))).otherwise(F.array("kind"))
    occ = open_spans.withColumn("class", F.explode(classes))
    seed = F.when(F.col("kind") == "number", F.when(F.col("class") == "phone", F.col("seed") == 1).otherwise(F.col("seed") == 2)).otherwise(F.col("seed") == 1)
    occ = occ.withColumn("hit", F.coalesce(seed, F.lit(False)).cast("int")).withColumn("rival", ((F.col("kind") == "number") & (F.col("seed") > 0)).cast("int") * (1 - F.col("hit")))
    # a name's instances are its words, anything else is one instance
    words = F.when(F.col("class") == "name", F.split("instance", " ")).otherwise(F.array("instance"))
    parted = occ.select("class", "hit", F.explode(words).alias("instance"), F.array("l", "r", "b").alias("patterns"))
    known = (F.col("class") == "name") & F.col("instance").startswith("*")
    parted = parted.select("class", "instance", F.explode("patterns").alias("pattern"), F.when(F.col("class") == "name", known.cast("int")).otherwise(F.col("hit")).alias("hit"))
    pairs = parted.groupBy("class", "instance", "pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("seeds"))
    lower = common.select(F.lit("name").alias("class"), F.col("word").alias("instance"), F.lit(1).alias("bad"))
    pairs = ws.stage(pairs.join(lower, ["class", "instance"], "left").withColumn("bad", F.coalesce("bad", F.lit(0))))
    instances, patterns = scored_graph(ws, pairs)
    total = 3 * spans.count()
    fan = heavy_keys(pairs.groupBy(F.xxhash64("class", "instance").alias("key")).agg(F.sum("n").alias("n")), "key", "n", total)
    by_instance = instances.select(F.xxhash64("class", "instance").alias("key"), F.col("score").alias("s"))
    parts = occ.where("hit = 0").select("class", "doc_id", "start", "stop", F.explode(words).alias("part")).withColumn("key", F.xxhash64("class", "part"))
    met = join_unique(parts, by_instance, "key", fan)
    of_parts = met.groupBy("class", "doc_id", "start", "stop").agg(F.avg(F.when(F.col("part").startswith("*"), 1.0).otherwise(F.col("s"))).alias("s"), F.min(F.when(F.col("part").startswith("*"), 1.0).otherwise(F.col("s"))).alias("low"))
    by_pattern = patterns.select(F.xxhash64("class", "pattern").alias("pk"), "p")
    fan = heavy_keys(pairs.groupBy(F.xxhash64("class", "pattern").alias("pk")).agg(F.sum("n").alias("n")), "pk", "n", total)
    asked = occ.select("class", "doc_id", "start", "stop", F.explode(F.array(*[F.xxhash64("class", c) for c in ("l", "r", "b")])).alias("pk"))
    contexts = join_unique(asked, by_pattern, "pk", fan).groupBy("class", "doc_id", "start", "stop").agg(F.max("p").alias("context"))
    scored = occ.drop("l", "r", "b").join(contexts, ["class", "doc_id", "start", "stop"]).join(of_parts, ["class", "doc_id", "start", "stop"], "left")
    counted = patterns.join(pairs.groupBy("class", "pattern").agg(F.sum("n").alias("n")), ["class", "pattern"])
    return scored.withColumn("s", F.coalesce("s", F.lit(1.0))).withColumn("low", F.coalesce("low", F.lit(1.0))), counted


def find_mentions(spark: SparkSession, documents: DataFrame, directory: list) -> DataFrame:
    """(doc_id, kind, start, stop, mention) of all accepted occurrences in documents (doc_id, text).

    ``directory``: (given name, family name) pairs, an incomplete list that fits the driver. Null and empty texts have
    no mentions. Overlapping candidates are settled per text: the better score, then the longer span, wins.
    """
    ws = Workspace(spark, "mentions")
    # from here on a pattern is only a key, so 64 bits of it do
    spans = ws.stage(candidate_spans(spark, documents, directory).withColumns({c: F.xxhash64(c) for c in ("l", "r", "b")}))
    mail = spans.where("kind = 'email'").select("doc_id", "kind", "start", "stop", "mention", F.lit(2.0).alias("score"))
    scored, patterns = scored_spans(ws, spans)
    context = F.col("context")
    accept = (
        F.when(F.col("class") == "name", (F.col("hit") == 1) & (F.col("instance").contains(" ") | F.col("instance").startswith("*") & (context >= 0.1)) | (F.col("low") > 0.1) & (F.col("s") * 0.5 + context * 0.5 >= 0.5))
        .when(F.col("hit") == 1, F.lit(True))
        .when(F.col("rival") == 1, F.lit(False))
        .when(F.col("class") == "address", (context >= 0.3) & (F.col("s") >= 0.15))
        .otherwise((context >= 0.4) & (F.col("s") >= 0.1) | (F.col("s") >= 0.5))
    )
    chosen = scored.where(accept).select("doc_id", F.col("class").alias("kind"), "start", "stop", "mention", (F.col("hit") + (context + F.col("s")) / 2).alias("score"))
    return _settled(ws.stage(mail.unionByName(chosen).unionByName(proposed_names(spark, documents, patterns))))


def proposed_names(spark: SparkSession, documents: DataFrame, patterns: DataFrame, sure: float = SURE, most: int = PROPOSERS) -> DataFrame:
    """(doc_id, kind, start, stop, mention, score) of runs of two or three Han characters between a left and a right pattern
    that both score ``sure`` or more, whatever the directory holds: patterns discover names that no list proposes.

    patterns: class, pattern (hash), p, n. Up to ``most`` sure ones are sent to the workers; if there are more, every run
    is joined with all of them, which gives the same rows. So what reaches the workers is bounded and no pattern is left out.
    """
    own = patterns.where((F.col("class") == "name") & (F.col("p") >= sure) & (F.col("p") > 0) & (F.col("n") >= 3)).select("pattern", "p")
    texts = documents.where(F.col("text").rlike("[一-鿿]{2}")).select("doc_id", "text")
    top = own.limit(most + 1).collect()
    if len(top) > most:
        return _joined_names(spark, texts, own)
    known = {r[0]: r[1] for r in top}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        memo: dict[str, float] = {}

        def score(pattern: str) -> float:
            if pattern not in memo:
                h = xxhash.xxh64_intdigest(pattern.encode(), seed=42)  # as the engine hashes a text
                memo[pattern] = known.get(h - (1 << 64) if h >> 63 else h, 0.0)
            return memo[pattern]

        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                for m in _HAN_RUN.finditer(text):
                    for i in range(m.start(), m.end() - 1):
                        left = _han_patterns(text, i, i)[0]
                        if score(left):
                            for j in (i + 3, i + 2):
                                if j <= m.end() and score(right := _han_patterns(text, i, j)[1]):
                                    out.append((doc, "name", i, j, text[i:j], (score(left) + score(right)) / 4))
            yield pd.DataFrame(out, columns=["doc_id", "kind", "start", "stop", "mention", "score"])

    return texts.mapInPandas(run, "doc_id bigint, kind string, start int, stop int, mention string, score double")


def _joined_names(spark: SparkSession, texts: DataFrame, own: DataFrame) -> DataFrame:
    """As proposed_names, from sure patterns (pattern, p) of any number: places meet left patterns, then right ones, by their hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                for m in _HAN_RUN.finditer(text):
                    for i in range(m.start(), m.end() - 1):
                        left = _han_patterns(text, i, i)[0]
                        out.extend((doc, i, j, text[i:j], left, _han_patterns(text, i, j)[1]) for j in (i + 3, i + 2) if j <= m.end())
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "mention", "l", "r"])

    ws = Workspace(spark, "proposed")
    met = texts.mapInPandas(run, "doc_id bigint, start int, stop int, mention string, l string, r string").withColumns({c: F.xxhash64(c) for c in "lr"})
    for side in "lr":
        met = ws.stage(met)
        counts = met.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        score = own.select(F.col("pattern").alias(side), F.col("p").alias(f"p{side}"))
        met = join_unique(met, score, side, heavy_keys(counts, side, "n", met.count()))
    return met.select("doc_id", F.lit("name").alias("kind"), "start", "stop", "mention", ((F.col("pl") + F.col("pr")) / 4).alias("score"))


def _settled(found: DataFrame) -> DataFrame:
    """Of overlapping spans of a text keeps the best; a text's spans meet in one row, as its text does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, spans in zip(pdf["doc_id"], pdf["spans"]):
                kept: list = []
                end_of = []
                for s in sorted(spans, key=lambda s: (-round(s["score"], 6), s["start"] - s["stop"], s["start"], s["kind"])):
                    if not any(s["start"] < b and a < s["stop"] for a, b in end_of):
                        kept.append(s)
                        end_of.append((s["start"], s["stop"]))
                out.extend((doc, s["kind"], s["start"], s["stop"], s["mention"]) for s in kept)
            yield pd.DataFrame(out, columns=["doc_id", "kind", "start", "stop", "mention"])

    grouped = found.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "start", "stop", "mention", "score")).alias("spans"))
    return grouped.mapInPandas(run, "doc_id bigint, kind string, start int, stop int, mention string")


def redacted(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """documents (doc_id, text) with each mention replaced by its kind in brackets, and the number of replacements."""
    per = mentions.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "kind")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, numbers = [], []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                spans = [] if spans is None or text is None else sorted(spans, key=lambda s: -s["start"])
                for s in spans:
                    text = text[: s["start"]] + f"[{s['kind'].upper()}]" + text[s["stop"] :]
                texts.append(text)
                numbers.append(len(spans))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "replaced": numbers})

    return documents.select("doc_id", "text").join(per, "doc_id", "left").mapInPandas(run, "doc_id bigint, text string, replaced int")


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, list]:
    people = [(r[0], r[1]) for r in table(spark, folder, "contact_directory").select("given_name", "family_name").collect()]  # a small table that does not grow
    return table(spark, folder, "documents").select("doc_id", "text"), people


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct mentions of every text."""
    return find_mentions(spark, *_inputs(spark, folder)).select("doc_id", "kind", "mention").distinct()


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders."""
    documents, people = _inputs(spark, folder)
    return redacted(documents, find_mentions(spark, documents, people))
