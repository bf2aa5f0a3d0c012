"""Abusive, hateful or sexual content by compression distance.

Texts are normalised against disguised spelling and cut into windows
(sentences, lines, overlapping pieces of long ones).  Two zstandard
dictionaries are made of windows of reviewed documents, one of ordinary and
one of toxic text.  A window's score is the number of bytes that the toxic
dictionary saves over the ordinary one, by its length; a document's score is
the highest of its windows, and it is reported from a threshold on.

Reviews are noisy, and most windows of a document judged toxic are ordinary.
So the toxic dictionary is refined in rounds: every reviewed document is
scored by dictionaries of the other folds, and only windows that score as
toxic stay.  The out-of-fold scores of the last round give the threshold.

A phrase that a single reviewed document has gets no support from other
folds.  If nothing in a document judged toxic scores as such, its window that
the ordinary dictionary saves least on is taken, provided that it is in no
ordinary document and that hardly any of these has one so novel.
"""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import checkpointed

#: Reviewed documents that the dictionaries are made of, at most; beyond, a sample by hash of the id.
MAX_REVIEWED = 20_000
#: Bytes of the dictionaries; more windows than fit are sampled.
ORDINARY_BYTES = 4 << 20
TOXIC_BYTES = 1 << 20
LEVEL = 19
FOLDS = 4
ROUNDS = 4
#: Characters of a window, and of the overlap of the windows that a longer one is cut into.
WINDOW = 120
OVERLAP = 60
#: Windows longer than the first are also scored in overlapping pieces of whole words, of about the second's length.
LONG, PIECE = 75, 60
#: Least out-of-fold score of a window that stays in the toxic dictionary, with and without a word triple
#: that leans to toxic documents.  Each pair is tried, and the strictest used whose out-of-fold F1 is within
#: STRICT_SLACK of the best: few reviews need the patient ones.
STAYS = ((-0.03, -0.03), (0.0, 0.03), (0.03, 0.2))
STRICT_SLACK = 0.01
#: Least threshold of a document.
LEAST_THRESHOLD = 0.08
#: F1 that may be given up for a higher threshold.
F1_SLACK = 0.003
MEMO = 100_000
#: Least share of its bytes that a window costs beside the ordinary dictionary, and the share of ordinary documents
#: without a window of their own that novel, for a toxic document's most novel window to be taken unsupported.
NOVEL, NOVEL_QUANTILE = 0.5, 0.985
#: Windows of an ordinary document that a model is fitted on, at most; those of longer ones are a sample by place.
FIT_WINDOWS = 500

# Digits and signs written for letters, and letters of other scripts that look like Latin ones.
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_LOOKALIKES = str.maketrans("авекмнорстухіјѕαεικνορτυχ", "abekmhopctyxijsaeiknoptux")


@lru_cache(maxsize=2)
def _patterns(ascii_only: bool) -> dict:
    """The patterns of :func:`normalised` and :func:`windows`; texts of ASCII alone have simpler ones."""
    import re

    import regex

    if ascii_only:
        compiled, letter, mark, digit, odd = re.compile, "a-z", "", "0-9", "0-9@$"
    else:
        compiled, letter, mark, digit, odd = regex.compile, r"\p{L}", r"\p{M}", r"\p{N}", r"\p{N}\p{M}@$\p{Cyrillic}\p{Greek}"
    of_token = f"[{letter}{mark}{digit}@$]"
    return {
        "invisible": regex.compile(r"\p{Cf}+"),
        # words in which something other than plain letters occurs
        "token": compiled(f"(?<!{of_token})[{letter}]*[{odd}]{of_token}*"),
        "masked": compiled(f"(?<=[{letter}])[_#*](?=[{letter}])"),
        "spaced": compiled(f"(?<![{letter}{mark}])(?:[{letter}][ .*_-]){{3,}}[{letter}](?![{letter}{mark}])"),
        "gap": compiled(r"[ .*_-]"),
        "repeated": compiled(f"([{letter}])\\1+"),
        "number": compiled(f"[{digit}]+"),
        "cut": compiled(r"[^\n\r.!?;。！？\t]+"),
        "other": compiled(f"[^{letter}{mark}{digit}]+"),
        "four": compiled(f"(?:[{letter}][^{letter}]*){{4}}"),
        "latin": regex.compile(r"\p{Latin}"),
        "foreign": regex.compile(r"[\p{Cyrillic}\p{Greek}]"),
    }


def _token(match) -> str:
    w = match.group()
    letters = sum(map(str.isalpha, w))
    if letters == len(w):
        p = _patterns(False)
        return w.translate(_LOOKALIKES) if p["latin"].search(w) and p["foreign"].search(w) else w
    signs = len(w) - letters
    if len(w) >= 8 and signs >= 3:
        return "0"
    return w.translate(_SIGNS) if letters >= 3 and letters > signs else w


def normalised(text: str) -> str:
    """Lower case without invisible characters, disguises undone, repeated letters and numbers reduced to one."""
    if text.isascii():
        text, p = text.lower(), _patterns(True)
    else:
        p = _patterns(False)
        text = p["invisible"].sub("", unicodedata.normalize("NFKC", text)).casefold()
    text = p["masked"].sub("", p["token"].sub(_token, text))
    text = p["spaced"].sub(lambda m: p["gap"].sub("", m.group()), text)
    return p["number"].sub("0", p["repeated"].sub(r"\1", text))


def windows(text: str) -> list[str]:
    """The distinct windows of the whole text, in order; of pieces with fewer than four letters only the text's sole one is a window."""
    text = normalised(text)
    p = _patterns(text.isascii())
    out, short = [], []
    for piece in p["cut"].findall(text):
        w = p["other"].sub(" ", piece).strip()
        while True:
            head = w[:WINDOW]
            if p["four"].search(head):
                out.append(head)
            elif head:
                short.append(head)
            if len(w) <= WINDOW:
                break
            w = w[WINDOW - OVERLAP :]
    if not out and len(set(short)) == 1 and any(map(str.isalpha, short[0])):
        out = short[:1]
    return list(dict.fromkeys(out))


#: What every dictionary ends with and every window begins with: the first match of a block costs more
#: than the others, and so it isn't the window's.
ANCHOR = bytes(range(1, 9)) + bytes(range(14, 30))


class Sizes:
    """Compressed sizes of windows by one dictionary.

    A match costs more bits the farther back it lies, so of two dictionaries
    the smaller looks better; padding evens that out.
    """

    def __init__(self, body: bytes, pad: int = 0):
        import zstandard

        body = body + b"\0" * max(0, pad - len(body)) + ANCHOR
        held = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __call__(self, w: bytes) -> int:
        return len(self._compress(ANCHOR + w))


def pieces(w: str) -> list[str]:
    """The window, and if it is long its overlapping pieces of whole words."""
    if len(w) <= LONG:
        return [w]
    out, words = [w], w.split(" ")
    at = 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (end == at or size + len(words[end]) <= PIECE):
            size += len(words[end]) + 1
            end += 1
        out.append(" ".join(words[at:end]))
        if end == len(words):
            break
        at += max(1, (end - at) // 2)
    return out


class Remembered(Sizes):
    """Sizes that are kept, for windows that are asked for again and again."""

    def __init__(self, body: bytes, pad: int = 0):
        super().__init__(body, pad)
        self.memo: dict[bytes, int] = {}

    def __call__(self, w: bytes) -> int:
        n = self.memo.get(w)
        if n is None:
            n = self.memo[w] = super().__call__(w)
        return n


class Scorer:
    """Scores by the two dictionaries; ``sizes`` may hold the ordinary one's sizes, if it is the longer one."""

    def __init__(self, ordinary: bytes, toxic: bytes, sizes: Sizes | None = None):
        self.ordinary = sizes if sizes and len(toxic) <= len(ordinary) else Sizes(ordinary, len(toxic))
        self.toxic = Sizes(toxic, len(ordinary))
        self.memo: dict[str, float] = {}

    def _score(self, w: str) -> float:
        b = w.encode("utf-8", "ignore")
        return (self.ordinary(b) - self.toxic(b)) / (len(b) + 10)

    def window(self, w: str) -> float:
        s = self.memo.get(w)
        if s is None:
            s = max(map(self._score, pieces(w)))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[w] = s
        return s

    def text(self, text: str | None) -> float:
        """The highest score of a window; -1 for a text without any (null, empty, without letters)."""
        return max((self.window(w) for w in windows(text)), default=-1.0) if text else -1.0


def dictionary(items: set[str], most: int) -> bytes:
    order = sorted(items)
    random.Random(1).shuffle(order)
    out, size = [], 0
    for w in order:
        b = w.encode("utf-8", "ignore") + b"\n"
        size += len(b)
        if size > most:
            break
        out.append(b)
    return b"".join(out)


def _threshold(best: dict[int, float], toxic: set[int]) -> tuple[float, float]:
    """Best F1 of reporting documents from a score on, and the highest threshold that all but reaches it."""
    order = sorted(best, key=lambda i: -best[i])
    hits, values = 0, []
    for n, i in enumerate(order, 1):
        hits += i in toxic
        if n == len(order) or best[order[n]] < best[i]:
            values.append((2 * hits / (n + len(toxic)), best[i]))
    f1 = max((v for v, _ in values), default=0.0)
    if not toxic or f1 <= 0:
        return 0.0, float("inf")
    return f1, max(LEAST_THRESHOLD, max(t for v, t in values if v >= f1 - F1_SLACK))


def _grams(w: str) -> set[tuple[str, ...]]:
    x = w.split()
    return {tuple(x[k : k + 3]) for k in range(len(x) - 2)} or {tuple(x)}


def _novelty(sizes: Sizes, w: str) -> float:
    """The share of a window's bytes that it costs beside the dictionary."""
    b = w.encode("utf-8", "ignore")
    return (sizes(b) - sizes(b"")) / max(1, len(b))


def train(reviewed: list[tuple[int, bool, list[str]]], setting: tuple[float, float]) -> tuple[float, bytes, bytes, float]:
    """Out-of-fold F1, ordinary dictionary, toxic dictionary and threshold from (doc_id, judged toxic, windows) by one of ``STAYS``.

    Without a document judged toxic, or without a gain, the threshold is infinite.
    """
    stays, alone = setting
    # copies of a document speak once
    first = {(bad, tuple(w)): i for i, bad, w in reversed(reviewed)}
    toxic = {i: list(w) for (bad, w), i in first.items() if bad}
    clean = {i: list(w[:: -(-len(w) // FIT_WINDOWS)] if w else w) for (bad, w), i in first.items() if not bad}
    in_toxic, in_clean, whole = Counter(), Counter(), Counter()
    for ws in toxic.values():
        in_toxic.update({g for w in ws for g in _grams(w)})
    for ws in clean.values():
        in_clean.update({g for w in ws for g in _grams(w)})
        whole.update(ws)
    # wrong verdicts: windows whose word triples speak clearly for the other side
    leans = {w: (any(in_toxic[g] >= 3 and in_toxic[g] >= 2 * in_clean[g] for g in _grams(w)), any(in_clean[g] >= 2 and in_clean[g] >= 4 * in_toxic[g] for g in _grams(w))) for ws in (*toxic.values(), *clean.values()) for w in ws}
    fold = {i: ((i * 0x9E3779B97F4A7C15) % 2**64 >> 40) % FOLDS for i in (*toxic, *clean)}
    ordinary = {i: [w for w in ws if not (leans[w][0] and not leans[w][1])] for i, ws in clean.items()}
    bodies = [dictionary({w for i, ws in ordinary.items() if fold[i] != f for w in ws}, ORDINARY_BYTES) for f in range(FOLDS)]
    sizes = [Remembered(body) for body in bodies]

    def out_of_fold(chosen: set[tuple[int, str]], documents: dict[int, list[str]]) -> dict[tuple[int, str], float]:
        score = {}
        for f in range(FOLDS):
            s = Scorer(bodies[f], dictionary({w for i, w in chosen if fold[i] != f}, TOXIC_BYTES), sizes[f])
            score.update({(i, w): s.window(w) for i, ws in documents.items() if fold[i] == f for w in ws})
        return score

    chosen = {(i, w) for i, ws in toxic.items() for w in ws if whole[w] == 0 and (leans[w][0] or not leans[w][1])}
    for _ in range(ROUNDS - 1):
        score = out_of_fold(chosen, toxic)
        chosen = {(i, w) for i, ws in toxic.items() for w in ws if score[i, w] >= (stays if leans[w][0] else alone) and (leans[w][0] or (whole[w] <= 1 and not leans[w][1]))}
    score = out_of_fold(chosen, toxic | clean)
    best = {i: max((score[i, w] for w in ws), default=-1.0) for i, ws in (*toxic.items(), *clean.items())}
    f1, threshold = _threshold(best, set(toxic))
    own = sorted(max((_novelty(sizes[fold[i]], w) for w in ws if whole[w] == 1), default=0.0) for i, ws in clean.items())
    least = max(NOVEL, own[min(len(own) - 1, int(NOVEL_QUANTILE * len(own)))]) if own else float("inf")
    for i, ws in toxic.items():
        new = [(_novelty(sizes[fold[i]], w), w) for w in ws if whole[w] == 0] if best[i] < threshold else []
        if new and max(new)[0] >= least:
            chosen.add((i, max(new)[1]))
    return f1, dictionary({w for ws in ordinary.values() for w in ws}, ORDINARY_BYTES), dictionary({w for _, w in chosen}, TOXIC_BYTES), threshold


def strictest(models: list[tuple]) -> tuple:
    """Of the models of all ``STAYS``, each beginning with its F1, the last one that all but reaches the best."""
    best = max(m[0] for m in models)
    return [m for m in models if m[0] >= best - STRICT_SLACK][-1] if models[0][0] > 0 else models[0]


def fit(documents: DataFrame, reviews: DataFrame) -> tuple[bytes, bytes, float]:
    """The dictionaries and threshold of :func:`train` from ``documents`` (doc_id, text) and ``reviews`` (doc_id, verdict).

    A document counts as toxic or ordinary by the majority of its ``remove``
    and ``keep`` verdicts; with as many of both it isn't used.  At most about
    ``MAX_REVIEWED`` documents are used, each setting in a task of its own.
    """
    votes = (
        reviews.filter("doc_id is not null and verdict in ('keep', 'remove')")
        .groupBy("doc_id")
        .agg(F.sum(F.when(F.col("verdict") == "remove", 1).otherwise(-1)).alias("vote"))
        .filter("vote <> 0")
    )
    n = votes.count()
    if n > MAX_REVIEWED:
        votes = votes.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < MAX_REVIEWED / n * (1 << 30))
    # bounded by MAX_REVIEWED rows
    used = documents.filter("text is not null").select("doc_id", "text").join(F.broadcast(votes), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(
                [batch["doc_id"], batch["vote"], pa.array([windows(t) for t in batch["text"].to_pylist()], pa.list_(pa.string()))], names=["doc_id", "vote", "windows"]
            )

    def learn(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        setting = key[0].as_py()
        own = {i: (v > 0, w) for i, v, w in zip(rows["doc_id"].to_pylist(), rows["vote"].to_pylist(), rows["windows"].to_pylist(), strict=True)}
        f1, a, b, t = train([(i, bad, w) for i, (bad, w) in sorted(own.items())], STAYS[setting])
        return pa.table({"setting": pa.array([setting], pa.int32()), "f1": [f1], "ordinary": [a], "toxic": [b], "threshold": [t]})

    cut_up = checkpointed(used.mapInArrow(cut, "doc_id long, vote long, windows array<string>"))
    each = cut_up.withColumn("setting", F.explode(F.array(*[F.lit(k) for k in range(len(STAYS))])))
    # one partition a setting
    got = each.repartitionById(len(STAYS), "setting").groupBy("setting").applyInArrow(learn, "setting int, f1 double, ordinary binary, toxic binary, threshold double").collect()
    if not got:
        return b"", b"", float("inf")
    model = strictest([(r["f1"], bytes(r["ordinary"]), bytes(r["toxic"]), r["threshold"]) for r in sorted(got, key=lambda r: r["setting"])])
    return model[1:]


def score_documents(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, source, score, toxic) of every document.

    The score is -1 for texts without a window (null, empty, no letters); null
    or repeated doc_ids keep their rows.  Without usable reviews no document
    is toxic.
    """
    spark = documents.sparkSession
    ordinary, toxic, threshold = fit(documents, reviews)
    model = spark.sparkContext.broadcast((ordinary, toxic))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(*model.value)
            yield pa.record_batch([batch["doc_id"], batch["source"], pa.array([scorer.text(t) for t in batch["text"].to_pylist()], pa.float64())], names=["doc_id", "source", "score"])

    scored = documents.select("doc_id", "source", "text").mapInArrow(score, "doc_id long, source string, score double")
    return scored.withColumn("toxic", F.col("score") >= F.lit(float(threshold)))


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, toxic_documents, rate) of every source; null is a source of its own."""
    n = F.count(F.lit(1))
    bad = F.count(F.when(F.col("toxic"), 1))
    return scored.groupBy("source").agg(n.alias("documents"), bad.alias("toxic_documents"), (bad / n).alias("rate"))
