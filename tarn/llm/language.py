"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The likelihood of a word is the sum over
all ways to cut it into pieces, by the forward algorithm; pieces don't cross white space, so a text's likelihood is the
product over its words, and each task works out a word once. Characters outside the vocabulary count as their bytes.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.session import store

from .common import cache_of

#: Documents per language to learn from, those with the smallest hash of the id.
SAMPLE = 2000
SMOOTHING = 0.1
UNKNOWN = "und"
HELD_BACK = 200_000  # words whose likelihoods a worker keeps; more are worked out again
_LETTER = re.compile(r"[^\W\d_]")
_LONG = 48  # longer words are scaled as they go
_BASE, _ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SLOTS, _SHIFTS = np.uint64((1 << 20) - 1), (44, 20, 10, 32, 4)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _hashed(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


class Vocabulary:
    """The pieces that a word can be cut into, and a segmenter for counting them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.processor.get_piece_size()
        self.ids = {}
        for i in range(self.size):
            piece = self.processor.id_to_piece(i)
            if not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i)) and "▁" not in piece[1:]:
                self.ids[piece] = i
        self.bytes = [self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))

    def counts(self, text: str) -> np.ndarray:
        return np.bincount(np.array(self.processor.encode(" ".join(text.lower().split())), dtype=np.int64), minlength=self.size)


class Scorer:
    """Log likelihoods of words in each language."""

    def __init__(self, vocab: Vocabulary, probs: np.ndarray) -> None:
        self.vocab, self.langs, self.probs = vocab, probs.shape[1], probs
        self.rare: dict[str, np.ndarray] = {}
        self.known: dict[str, int] = {}
        self.rows = np.zeros((HELD_BACK, self.langs))
        # pieces by the hash of their characters, in two tables: the second has those whose place in the first is taken
        keys = np.zeros(len(vocab.ids), dtype=np.uint64)
        for i, piece in enumerate(vocab.ids):
            keys[i] = _hashed(piece)
        ids, self.tables = np.array(list(vocab.ids.values()), dtype=np.int32), []
        while len(keys):
            shift = _SHIFTS[len(self.tables)]
            slot = ((keys * _ODD) >> np.uint64(shift)) & _SLOTS
            _, first = np.unique(slot, return_index=True)
            key, value = np.zeros(int(_SLOTS) + 1, dtype=np.uint64), np.full(int(_SLOTS) + 1, -1, dtype=np.int32)
            key[slot[first]], value[slot[first]] = keys[first], ids[first]
            self.tables.append((shift, key, value))
            keys, ids = np.delete(keys, first), np.delete(ids, first)

    def _char(self, c: str) -> np.ndarray:
        if c not in self.rare:
            if len(self.rare) > 10_000:
                self.rare.clear()
            self.rare[c] = np.prod([self.probs[self.vocab.bytes[b]] for b in c.encode("utf-8", "surrogatepass")], axis=0)
        return self.rare[c]

    def _long(self, word: str) -> np.ndarray:
        get, most = self.vocab.ids.get, self.vocab.longest
        window, total = [np.ones(self.langs)], np.zeros(self.langs)  # the last ``most`` sums, all on the scale of ``total``
        for j in range(1, len(word) + 1):
            now = np.zeros(self.langs)
            for k in range(1, min(j, most) + 1):
                p = get(word[j - k:j], -1)
                if p >= 0:
                    now += window[-k] * self.probs[p]
                elif k == 1:
                    now += window[-1] * self._char(word[j - 1])
            window = [w / now for w in [*window[-most + 1:], now]]
            total += np.log(now)
        return total

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int32)
        mixed = keys * _ODD
        for shift, key, value in self.tables:
            slot = (mixed >> np.uint64(shift)) & _SLOTS
            hit = key[slot] == keys
            out[hit] = value[slot[hit]]
        return out

    def _short(self, words: list[str]) -> np.ndarray:
        """The forward sums of words of at most ``_LONG`` characters, longest first, for all words together."""
        code = np.frombuffer(("▁" + "▁".join(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        size = np.array([len(w) + 1 for w in words])
        start = np.cumsum(size) - size
        room = np.repeat(start + size, size) - np.arange(len(code))  # characters from here to the word's end
        probs, ids, at, key = self.probs, [], np.arange(len(code)), np.zeros(len(code), dtype=np.uint64)
        for k in range(1, min(self.vocab.longest, int(size[0])) + 1):
            live = room[at] >= k
            at, key = at[live], key[live]
            key = key * _BASE + code[at + k - 1]
            found = np.full(len(code), -1, dtype=np.int32)
            found[at] = self._lookup(key)
            if k == 1 and (odd := np.flatnonzero(found < 0)).size:
                chars, which = np.unique(code[odd], return_inverse=True)
                found[odd] = len(probs) + which
                probs = np.vstack([probs, [self._char(chr(c)) for c in chars.tolist()]])
            ids.append(found)
        sums, out = [np.ones((len(words), self.langs))], np.zeros((len(words), self.langs))
        for j in range(1, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -j, side="right"))  # words with at least j characters come first
            now = np.zeros((n, self.langs))
            for k in range(1, min(j, len(ids)) + 1):
                p = ids[k - 1][start[:n] + j - k]
                some = np.flatnonzero(p >= 0)
                if some.size:
                    now[some] += sums[j - k][some] * probs[p[some]]
            sums.append(now)
            ended = slice(int(np.searchsorted(-size, -j, side="left")), n)
            out[ended] = np.log(now[ended])
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """(words, languages): log of the sum over all segmentations."""
        out = np.zeros((len(words), self.langs))
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        cut = next((k for k, i in enumerate(order) if len(words[i]) < _LONG), len(order))
        for i in order[:cut]:
            out[i] = self._long("▁" + words[i])
        for a in range(cut, len(order), 50_000):
            part = order[a:a + 50_000]
            out[part] = self._short([words[i] for i in part])
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): sums over the words of each text."""
        out, a = np.zeros((len(texts), self.langs)), 0
        while a < len(texts):
            cut, words = [], 0  # as many texts as have some 100,000 words
            while a + len(cut) < len(texts) and (not cut or words < 100_000):
                cut.append(texts[a + len(cut)].lower().split())
                words += len(cut[-1])
            new = [w for w in {w for c in cut for w in c} if w not in self.known]
            if len(self.known) + len(new) > HELD_BACK:
                self.known, new = {}, list({w for c in cut for w in c})
                self.rows = self.rows if len(new) <= len(self.rows) else np.zeros((len(new), self.langs))
            if new:
                first = len(self.known)
                self.known.update(zip(new, range(first, first + len(new)), strict=True))
                self.rows[first:first + len(new)] = self.words(new)
            for t, c in enumerate(cut, a):
                if c:
                    out[t] = self.rows[np.fromiter(map(self.known.__getitem__, c), dtype=np.int64, count=len(c))].sum(axis=0)
            a += len(cut)
        return out


def _vocabulary(path: str) -> Vocabulary:
    held = cache_of("language")
    if ("vocabulary", path) not in held:
        held["vocabulary", path] = Vocabulary(path)
    return held["vocabulary", path]


def learn(docs: DataFrame, path: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from ``docs`` (doc_id, text, lang).

    Learns from at most ``sample`` documents a language: a bounded sample, dealt by a hash of the id. The result has one row per piece
    of the vocabulary and one column per language.
    """
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy("lang").orderBy("h")
    cuts = docs.select("lang", "h").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).groupBy("lang").agg(F.max("h").alias("cut"))
    chosen = docs.join(F.broadcast(store(cuts)), "lang").filter("h <= cut").select("lang", "text")

    def count(frames):
        import pandas as pd

        vocab, sums = _vocabulary(path), {}
        for f in frames:
            for lang, text in zip(f["lang"].tolist(), f["text"].tolist(), strict=True):
                sums[lang] = sums.get(lang, 0) + vocab.counts(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "piece": at, "n": n[at]})

    rows = chosen.mapInPandas(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs, size = sorted(rows["lang"].unique().tolist()), _vocabulary(path).size
    n = np.zeros((size, len(langs)))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        n[own["piece"].to_numpy(), k] = own["n"].to_numpy()
    return langs, (n + SMOOTHING) / (n + SMOOTHING).sum(axis=0) if langs else n


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             path: str | None = None, sample: int = SAMPLE, key_col: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of lang_pred with equal priors) of every row.

    ``key_col``: a column of whole numbers to hand on as well, which tells rows apart whose ids don't.

    The prediction looks at the whole text alone. A text that is null or has no letter is ``und`` with score 0, as are all if
    there is nothing to learn from. Equally likely languages: the first by code point. Repeated rows are judged each by
    itself; other columns are ignored; no rows give no rows.
    """
    path = path or vocabulary()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"),
                       *([F.col(f"`{key_col}`").alias("key")] if key_col else []))
    kept = ["doc_id", "held_out", *(["key"] if key_col else [])]
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows.filter("NOT held_out"), path, sample))
    key = uuid.uuid4().hex  # workers serve more than one query

    def predict(frames):
        langs, probs = model.value
        held = cache_of("language")
        if held.get("model") != key:
            held.update(model=key, scorer=None)  # the last model's goes first
            held["scorer"] = Scorer(_vocabulary(path), probs) if langs else None
        scorer = held["scorer"]
        for f in frames:
            texts = [t if t and langs and _LETTER.search(t) else "" for t in f["text"].tolist()]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if t]
            if some:
                logs = scorer.texts([texts[i] for i in some])
                best = logs.argmax(axis=1)
                score[some] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b in zip(some, best.tolist(), strict=True):
                    pred[i] = langs[b]
            yield f[kept].assign(lang_pred=pred, score=score)

    named = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", *kept[2:], "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = named.mapInPandas(predict, f"doc_id string, held_out boolean, {'key long, ' if key_col else ''}lang_pred string, score double")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnsRenamed({"key": key_col} if key_col else {})
