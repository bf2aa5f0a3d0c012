"""Token ids of a whole corpus by a public byte-level BPE, computed by DuckDB queries in every partition.

A text is cut into words by the tokenizer's pattern.  The distinct words that
the partition hasn't met yet become rows (word, position, token) in DuckDB; a
recursive query joins neighbouring tokens with the merge table, contracts
each word's pairs of minimum rank, leftmost first, and repeats until no pair
of any word is in the table.  Ordered aggregation gives each word's ids, and
again each text's.

A step contracts more than one pair of a word where that gives what one
contraction at a time does:

* All occurrences of the word's minimum-rank pair (of overlapping ones the
  1st, 3rd, ... of the run): contracting one of them makes no pair of lower
  rank, as every pair with the new token was learnt after it.
* A pair (a, b) of any rank r between neighbours x and y, if no token that ends
  with x a, and none that begins with b y, has a rank of r or less.  Tokens
  only grow, so whatever takes a from the left makes a token that ends with
  x a, and it would have to come before (a, b), which has a lower rank; the
  same holds for b.  So a and b meet whatever happens around them.

A word falls apart where no token can ever reach across two neighbours; its
parts have minima of their own and are done one by one.  So the steps that a
long word needs hardly grow with its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut into words; a fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone.
ASCII_PATTERN = PATTERN.replace(r"^\s\p{L}\p{N}", r"^\t-\r A-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")
#: Characters of text, and distinct words, that a worker holds at once.
BLOCK_CHARS = 1 << 20
KNOWN_WORDS = 200_000
#: Token rows that the steps of one recursion may add up to.
STEP_ROWS = 2_000_000
MEMORY = "256MB"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


@lru_cache(maxsize=2)
def merge_table(path: str) -> pa.Table:
    """(l, r, m, ends, starts) for every pair of tokens that may come to lie within one token.

    m is the id, and rank, of the token they make, or null; ``ends`` and
    ``starts`` are the least ranks of the tokens that end, and that begin,
    with the two, or null.  A token's own pair is the last one that building
    it from bytes meets, so every way to cut a token into two tokens is a
    merge of that token's rank.
    """
    ranks = vocabulary(path)
    ends: dict[bytes, int] = {}
    starts: dict[bytes, int] = {}
    tails: dict[bytes, list[int]] = {}
    heads: dict[bytes, list[int]] = {}
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        for i in range(2, len(token) + 1):
            starts.setdefault(token[:i], rank)
            ends.setdefault(token[-i:], rank)
        heads[token] = [k for i in range(1, len(token) + 1) if (k := ranks.get(token[:i])) is not None]
        tails[token] = [k for i in range(1, len(token) + 1) if (k := ranks.get(token[-i:])) is not None]
    rows = {}
    for held in ends.keys() | starts.keys():
        made, at_end, at_start = ranks.get(held), ends.get(held), starts.get(held)
        for i in range(1, len(held)):
            a = ranks.get(held[:i])
            if a is not None and (b := ranks.get(held[i:])) is not None:
                rows[a, b] = made, at_end, at_start
    # a token of two tokens may also hold the last part of one and the first part of the other at its inside
    for token in ranks:
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                for a in tails[token[:i]]:
                    for b in heads[token[i:]]:
                        if (a, b) not in rows:
                            rows[a, b] = None, None, None
    left, right = zip(*rows, strict=True)
    made, at_end, at_start = zip(*rows.values(), strict=True)
    return pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("l", "r", "m", "ends", "starts"), (left, right, made, at_end, at_start), strict=True)})


_CONTRACT = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE step(word, part, pos, token, rank, ends, starts, apart, open, turn) AS (
  SELECT p.word, 0, p.pos, p.token, m.m, m.ends, m.starts, m.l IS NULL, true, 0
  FROM (SELECT word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos) AS after FROM piece) p LEFT JOIN merge m ON m.l = p.token AND m.r = p.after
  UNION ALL
  SELECT word, part, pos, token, rank, ends, starts, apart, open, turn FROM (
    WITH live AS MATERIALIZED (
      SELECT word, coalesce(max(CASE WHEN apart THEN pos + 1 END) OVER (place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), part) AS part,
             pos, token, rank, ends, starts, apart, turn, row_number() OVER place AS nth,
             coalesce(rank < coalesce(lag(ends) OVER place, 2147483647) AND rank < coalesce(lead(starts) OVER place, 2147483647), false) AS sure
      FROM step WHERE open AND turn < $turns WINDOW place AS (PARTITION BY word, part ORDER BY pos)
    ), least AS MATERIALIZED (
      SELECT word, part, min(rank) AS best FROM live GROUP BY word, part
    ), hit AS (
      -- hits of a pair of equal tokens may overlap: of every run of neighbours the 1st, 3rd, ... are contracted
      SELECT s.word, s.part, s.pos, s.nth - row_number() OVER (PARTITION BY s.word, s.part ORDER BY s.pos) AS island
      FROM live s JOIN least t ON t.word = s.word AND t.part = s.part WHERE s.rank = t.best AND t.best IN (SELECT m FROM twins)
    ), odd AS (
      SELECT word, pos FROM (SELECT word, pos, row_number() OVER (PARTITION BY word, part, island ORDER BY pos) AS place FROM hit) WHERE place % 2 = 0
    ), chosen AS (
      SELECT s.word, s.part, s.pos, s.token, s.rank, s.ends, s.starts, s.apart, s.turn, s.sure OR (coalesce(s.rank = l.best, false) AND o.pos IS NULL) AS takes
      FROM live s JOIN least l ON l.word = s.word AND l.part = s.part LEFT JOIN odd o ON o.word = s.word AND o.pos = s.pos WHERE l.best IS NOT NULL
    ), told AS (
      SELECT word, part, pos, rank, ends, starts, apart, turn, takes, CASE WHEN takes THEN rank ELSE token END AS token,
             coalesce(lag(takes) OVER place, false) AS taken, takes OR coalesce(lead(takes) OVER place, false) AS fresh,
             CASE WHEN takes THEN lead(CASE WHEN takes THEN rank ELSE token END, 2) OVER place ELSE lead(CASE WHEN takes THEN rank ELSE token END) OVER place END AS after
      FROM chosen WINDOW place AS (PARTITION BY word, part ORDER BY pos)
    )
    -- only pairs beside a contraction are looked up again
    SELECT t.word, t.part, t.pos, t.token, CASE WHEN fresh THEN m.m ELSE t.rank END AS rank, CASE WHEN fresh THEN m.ends ELSE t.ends END AS ends,
           CASE WHEN fresh THEN m.starts ELSE t.starts END AS starts, CASE WHEN fresh THEN m.l IS NULL ELSE t.apart END AS apart, true AS open, t.turn + 1 AS turn
    FROM told t LEFT JOIN merge m ON m.l = CASE WHEN fresh THEN t.token END AND m.r = t.after WHERE NOT taken
    UNION ALL
    SELECT s.word, 0, s.pos, s.token, NULL, NULL, NULL, NULL, false, s.turn FROM live s JOIN least l ON l.word = s.word AND l.part = s.part WHERE l.best IS NULL
  )
)
SELECT word, pos, token, open FROM step WHERE NOT open OR turn = $turns
"""


class Encoder:
    """Words of a partition and their ids, in one DuckDB connection."""

    def __init__(self, path: str):
        import re

        import duckdb
        import regex

        self.cut, self.cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        ranks = vocabulary(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.register("merges", merge_table(path))
        self.db.execute("CREATE TEMP TABLE merge AS SELECT * FROM merges")
        self.db.execute("CREATE TEMP TABLE twins AS SELECT DISTINCT m FROM merges WHERE l = r AND m IS NOT NULL")
        self.db.unregister("merges")
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.db.execute("CREATE OR REPLACE TEMP TABLE word (word INTEGER, ids INTEGER[])")

    def _learn(self, fresh: dict[str, int]) -> None:
        words, places, tokens = [], [], []
        for w, k in fresh.items():
            raw = w.encode("utf-8", "surrogatepass")
            words.extend([k] * len(raw))
            places.extend(range(len(raw)))
            tokens.extend([self.byte[b] for b in raw])
        self.db.register("given", pa.table({"word": pa.array(words, pa.int32()), "pos": pa.array(places, pa.int32()), "token": pa.array(tokens, pa.int32())}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE piece AS SELECT * FROM given")
        self.db.unregister("given")
        # a recursion keeps the rows of all its steps; what is left after as many as fit goes into another one
        left = len(words)
        while left:
            self.db.execute(_CONTRACT.replace("$turns", str(max(8, STEP_ROWS // left))))
            self.db.execute("INSERT INTO word SELECT word, list(token ORDER BY pos) FROM coded GROUP BY word HAVING NOT bool_or(open)")
            self.db.execute("CREATE OR REPLACE TEMP TABLE piece AS SELECT word, pos, token FROM coded WHERE word IN (SELECT word FROM coded WHERE open)")
            left = self.db.execute("SELECT count(*) FROM piece").fetchall()[0][0]

    def encode(self, texts: list[str]) -> pa.Array:
        """The ids of every text; an empty text gives an empty list."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        words: list[str] = []
        ends = []
        for text in texts:
            words += (self.cut_ascii if text.isascii() else self.cut)(text)
            ends.append(len(words))
        fresh = {w: len(self.known) + k for k, w in enumerate(dict.fromkeys(w for w in words if w not in self.known))}
        self.known |= fresh
        if fresh:
            self._learn(fresh)
        word = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
        self.db.register("used", pa.table({"doc": doc, "place": np.arange(len(words), dtype=np.int32), "word": word}))
        self.db.register("every", pa.table({"doc": pa.array(range(len(texts)), pa.int32())}))
        got = self.db.sql(
            "SELECT e.doc, coalesce(t.ids, []) AS ids FROM every e LEFT JOIN "
            "(SELECT u.doc, flatten(list(w.ids ORDER BY u.place)) AS ids FROM used u JOIN word w USING (word) GROUP BY u.doc) t ON t.doc = e.doc ORDER BY e.doc"
        ).to_arrow_table()
        self.db.unregister("used")
        self.db.unregister("every")
        return got["ids"].combine_chunks().cast(pa.list_(pa.int32()))


def encode_corpus(documents: DataFrame, ident: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(ident, ids ARRAY<INT>) of every row: the ids of its text by ``byte_bpe_50k`` without special tokens.

    Null and empty texts give an empty list; strings that look like special
    tokens are ordinary text.  Rows with repeated or null idents each give a
    row of their own.
    """
    path = f"{tokenizers.rstrip('/')}/{VOCABULARY}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            texts = [t or "" for t in batch["_text"].to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
                    size += len(texts[end])
                    end += 1
                yield pa.record_batch([batch["_id"].slice(at, end - at), encoder.encode(texts[at:end])], names=["_id", "ids"])
                at = end

    kind = documents.schema[ident].dataType.simpleString()
    return (
        documents.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
        .mapInArrow(encode, f"_id {kind}, ids array<int>")
        .select(F.col("_id").alias(ident), "ids")
    )
