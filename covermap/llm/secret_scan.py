"""Secret scans: candidates by shape, and a random forest that removes the false ones.

A candidate is a run of at least LEAST_LENGTH key characters that holds a digit, or the value of LEAST_GIVEN characters of any
kind or more that is given to a word such as ``password``, as in code, JSON and YAML. The forest sees its length, the changes between kinds of characters, how much of it the corpus's
own words cover, whether it is part of a path, address or number, and the words around it. It is trained from labelled
findings; where none are given, those whose format settles the matter are the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from covermap.llm.common import kept, slices
from covermap.llm.lm_scoring import common_words, count_words

LEAST_LENGTH = 12
LEAST_GIVEN = 6
#: Characters of a finding that are shown, and the parts of it of which one is shown at most.
SHOWN = 4
#: Words whose value is a secret, in alphabetical order.
KEY_WORDS = (
    "access_key", "accesskey", "api_key", "apikey", "auth", "authorization", "bearer", "client_secret", "credential", "credentials",
    "key", "passphrase", "passwd", "password", "private_key", "pwd", "secret", "secret_key", "token",
)
#: Formats that issuers publish for their keys.
FORMATS = (
    r"AKIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_-]{35}", r"gh[pousr]_[0-9A-Za-z]{36,}", r"glpat-[0-9A-Za-z_-]{20,}", r"sk_live_[0-9A-Za-z]{20,}",
    r"xox[abprs]-[0-9A-Za-z-]{10,}", r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]*",
)
#: The corpus's commonest words of four letters or more make the dictionary.
DICTIONARY = 50_000
#: At most about so many labelled findings, chosen by hash, train the forest; fewer are all used.
TRAINING_ROWS = 20_000
TREES = 20
DEPTH = 6
FEATURES = (
    "length", "digits", "capitals", "small", "signs", "letter_digit_changes", "case_changes", "sign_changes", "entropy", "distinct", "hex",
    "longest_letters", "dictionary_cover", "longest_word", "path", "address", "number", "given", "key_word_near", "quoted",
    "known_before", "known_after", "ends_sentence", "issued",
)

_RUN = re.compile(rb"[A-Za-z0-9+/_=.@:$%%&~\-]{%d,}|[A-Za-z_]{3,20}[=:][A-Za-z0-9+/_.@$%%&~!\-]{%d,}" % (LEAST_LENGTH, LEAST_GIVEN))
_GIVEN = re.compile(rb"^([A-Za-z_][A-Za-z_\-]{1,30})[=:]+(.{%d,})$" % LEAST_GIVEN, re.S)
_DIGIT = re.compile(rb"[0-9]")
_ISSUED = re.compile("(?:" + "|".join(FORMATS) + ")\\Z")
_EMAIL, _IP = re.compile(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\Z"), re.compile(r"\d{1,3}(\.\d{1,3}){3}\Z")
_KEYS = frozenset(KEY_WORDS)
_KEY_BYTES = frozenset(word.encode() for word in KEY_WORDS)
_LETTERS = re.compile("[A-Za-z]+")
_SIGN = re.compile(rb"=>|:=|==|[:=]")
#: A key word before the sign: alone, as the last part of a longer name, or, from six letters on, at the end of any name.
_NAME = re.compile(
    rb"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?=[A-Za-z_]{6}))((?i:%s))[\"'`\\\]]{0,3}[ \t]*\Z" % b"|".join(sorted(_KEY_BYTES, key=lambda word: (-len(word), word))))
_VALUE = re.compile(rb"[ \t]*(?:(?i:bearer|basic|token)[ \t]+)?(?:(\\?[\"'`])(.{%d,}?)\1|[\"'`]?([^\s\"'`:=][^\s\"'`]{%d,}))" % (LEAST_GIVEN, LEAST_GIVEN - 1))


_ANY_KEY = b"|".join(sorted(_KEY_BYTES, key=lambda word: (-len(word), word)))
#: The password in a URL's user information.
_USER = re.compile(rb"://[^\s/:@]*:([^\s/@]{%d,})@" % LEAST_GIVEN)
#: An element, and an option or setting of a command line, whose name ends in a key word.
_ELEMENT = re.compile(rb"<(?:[\w.\-]*?[._\-])?((?i:%s))>[ \t]*([^<>\s]{%d,})[ \t]*</" % (_ANY_KEY, LEAST_GIVEN))
_OPTION = re.compile(rb"(?<![\w\-])(?:--?(?:\w[\w\-]*?[\-_])?|(?:export|setenv|setx|set)[ \t]+(?:-\w+[ \t]+)?(?:\w*?_)?)((?i:%s))[ \t]+[\"']?([^\s\"'=:]{%d,})"
                     % (_ANY_KEY, LEAST_GIVEN))


def _given_values(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, end, key word) of each value given to a key word, quoted or not, of at least LEAST_GIVEN characters of any kind.

    A value is given by a sign, as the text of an element, after an option of a command line, or as the password of a URL.
    """
    for sign in _SIGN.finditer(text):
        name = _NAME.search(text[max(0, sign.start() - 40) : sign.start()])
        value = name and _VALUE.match(text, sign.end())
        if not value:
            continue
        if value.group(2) is not None:
            yield *value.span(2), name.group(1).lower()
        elif len(own := value.group(3).rstrip(b".,;:=)]}>")) >= LEAST_GIVEN:
            yield value.start(3), value.start(3) + len(own), name.group(1).lower()
    for user in _USER.finditer(text):
        yield *user.span(1), b"password"
    for form in (_ELEMENT, _OPTION):
        for given in form.finditer(text):
            yield *given.span(2), given.group(1).lower()


def _runs(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    for run in _RUN.finditer(text):
        found, start = run.group(), run.start()
        stripped = found.rstrip(b".:=")
        if given := _GIVEN.match(stripped):
            if given.group(1).lower() in _KEY_BYTES or _DIGIT.search(given.group(2)):
                yield start + given.start(2), start + given.end(2), given.group(1).lower()
        elif len(stripped) >= LEAST_LENGTH and _DIGIT.search(stripped):
            yield start, start + len(stripped), b""


def candidates(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, end, the word it is given to or nothing) of each candidate in a whole text; a run inside a given value is a part of it."""
    values = {(start, end): word for start, end, word in _given_values(text)}
    if not values:
        yield from _runs(text)
        return
    found = dict(values)
    spans, first, since, reach = sorted(values), 0, 0, 0
    for start, end, word in _runs(text):
        while first < len(spans) and spans[first][0] <= start:
            if spans[first][1] > reach:
                since, reach = spans[first]
            first += 1
        # A run that is exactly a given value adds nothing: the value keeps its key word.
        if (start, end) not in values and not (reach > end or (reach == end and since < start)):
            found[start, end] = word
    yield from ((start, end, word) for (start, end), word in sorted(found.items()))


def _changes(text: str, kind) -> int:
    kinds = [kind(c) for c in text]
    return sum(a is not None and b is not None and a != b for a, b in zip(kinds, kinds[1:]))


def dictionary_cover(text: str, dictionary: frozenset[str]) -> tuple[float, int]:
    """The share of a candidate's characters in words of the dictionary, longest first from the left; and the longest of them."""
    covered = longest = 0
    for letters in _LETTERS.findall(text.lower()):
        at = 0
        while at < len(letters):
            for end in range(min(len(letters), at + 16), at + 3, -1):
                if letters[at:end] in dictionary:
                    covered, longest, at = covered + end - at, max(longest, end - at), end
                    break
            else:
                at += 1
    return covered / len(text), longest


def features(text: bytes, start: int, end: int, given: bytes, dictionary: frozenset[str]) -> list[float]:
    """The FEATURES of a candidate in its text."""
    own = text[start:end].decode("utf-8", "replace")
    size = len(own)
    count = lambda test: sum(map(test, own)) / size
    shares = [own.count(c) / size for c in set(own)]
    cover, longest = dictionary_cover(own, dictionary)
    before, after = text[max(0, start - 60) : start].decode("utf-8", "ignore"), text[end : end + 40].decode("utf-8", "ignore")
    words_before = [w.strip(".,;:\"'=()").lower() for w in before.split()[-4:]]
    words_after = [w.strip(".,;:\"'=()").lower() for w in after.split()[:3]]
    near = any(word in _KEYS for word in words_before)
    assigned = bool(given) or (bool(re.search(r"[=:]\s*[\"']?$", before)) and near)
    known = lambda words: sum(word in dictionary for word in words) / max(len(words), 1)
    return [float(x) for x in (
        size, count(str.isdigit), count(str.isupper), count(str.islower), count(lambda c: not c.isalnum()),
        _changes(own, lambda c: "d" if c.isdigit() else "l" if c.isalpha() else None) / size,
        _changes(own, lambda c: "u" if c.isupper() else "l" if c.islower() else None) / size,
        _changes(own, lambda c: c.isalnum()) / size, -sum(share * log2(share) for share in shares), len(shares) / size,
        bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", own)), max(map(len, _LETTERS.findall(own)), default=0), cover, longest,
        own.count("/") + before.endswith(("/", "\\", "://")), bool(_EMAIL.match(own) or _IP.match(own)) + before.endswith("@"),
        bool(re.fullmatch(r"[\d.:+\-]+", own)), assigned, near or given.decode() in _KEYS, before.endswith(("\"", "'")), known(words_before),
        known(words_after), after.startswith((".", "\n")) or not after, bool(_ISSUED.match(own)),
    )]


def format_label(own: str, values: list[float]) -> float | None:
    """1 for a published format or a mixed value given to a key word, 0 for numbers, addresses, paths and words, else None."""
    value = dict(zip(FEATURES, values))
    if value["issued"]:
        return 1.0
    given = value["given"] and value["key_word_near"] and value["digits"]
    # Before all that speaks against it: a mixed key may well hold slashes.
    mixed = value["letter_digit_changes"] >= 0.15 or value["case_changes"] >= 0.25
    if given and value["digits"] < 1 and mixed and not value["address"] and value["dictionary_cover"] < 0.6:
        return 1.0
    if value["number"] or value["address"] or value["path"] >= 2 or (value["dictionary_cover"] >= 0.6 and not given):
        return 0.0
    if given and value["digits"] < 1 and value["letter_digit_changes"] >= 0.15:
        return 1.0
    return None


def _findings(documents: DataFrame, words: list[tuple[bytes, int]]) -> DataFrame:
    """(doc_id, start, end, found, features, label) of each candidate; start and end count bytes."""
    letters = [word.decode("utf-8", "ignore").strip(".,;:!?") for word, _ in words]
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(w for w in letters if len(w) >= 4 and w.isascii() and w.isalpha()))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1)):
                rows = []
                for place, text in enumerate(texts):
                    for start, end, given in candidates(text):
                        values, own = features(text, start, end, given, dictionary), text[start:end].decode("utf-8", "replace")
                        rows.append((ids[first + place], start, end, own, values, format_label(own, values)))
                if rows:
                    columns = [list(column) for column in zip(*rows)]
                    yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds)], names=names)

    names = ["doc_id", "start", "end", "found", "features", "label"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.float64()]
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        searched, "doc_id bigint, start bigint, end bigint, found string, features array<double>, label double")


def scan_secrets(documents: DataFrame, labels: DataFrame | None = None, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, start, end, masked, score, is_secret), one row per candidate.

    start and end are bytes of the text, masked is the candidate with all but its first quarter, SHOWN characters at most, hidden, score the
    forest's probability that it is a secret. ``labels`` are (doc_id, start, secret 0/1); without them the formats' own
    verdicts are the labels. Null and empty texts have no candidates. Repeated rows are reported each. With labels of
    fewer than two classes, every candidate gets that class, or counts as a secret. Other columns are not read.
    """
    texts = documents.select("doc_id", "text")
    dictionary = common_words(kept(count_words(texts)), DICTIONARY)
    found = _findings(texts, dictionary)
    if labels is not None:
        marked = labels.groupBy(F.col("doc_id").alias("of"), F.col("start").alias("at")).agg(F.max(F.col("secret").cast("double")).alias("marked"))
        found = found.join(marked, (F.col("doc_id") == F.col("of")) & (F.col("start") == F.col("at")), "left").withColumn("label", F.col("marked")).drop("of", "at", "marked")
    found = kept(found).withColumn("features", array_to_vector("features"))
    counts = {row.label: row["count"] for row in found.where("label is not null").groupBy("label").count().collect()}
    if len(counts) < 2:
        scored = found.withColumn("score", F.lit(float(next(iter(counts), 1.0))))
    else:
        share = min(1.0, training_rows / sum(counts.values()))
        chosen = F.pmod(F.xxhash64("doc_id", "start", "found"), F.lit(1 << 20)) < (int(share * (1 << 20)) if share < 1 else 1 << 20)
        training = kept(found.where(F.col("label").isNotNull() & chosen).select("features", "label").repartition(4))
        model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=13).fit(training)
        scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    shown = F.least(F.lit(SHOWN), F.floor(F.length("found") / SHOWN).cast("int"))
    masked = F.concat(F.left("found", shown), F.repeat(F.lit("*"), F.length("found") - shown))
    return scored.select("doc_id", "start", "end", masked.alias("masked"), "score", (F.col("score") >= 0.5).alias("is_secret"))
