"""Language ID: unigram piece models over a fixed public vocabulary, with all segmentations summed.

Training counts the vocabulary's pieces in each language's texts, all of them, and so gives piece probabilities by
language. A text's likelihood in a language is the product over its words, and that of a word is the sum over all ways to
cut it into pieces, by the forward algorithm, in logarithms. The model is pieces x languages, whatever the input. Each batch
runs the algorithm once on its distinct words, position by position for all of them. Words of any length are summed whole:
long ones go by in units, and from one to the next the values of as many positions go on as the longest piece reaches back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merkleframe.llm import arrays as A
from merkleframe.llm.tokens import VOCABULARY, load_vocabulary, tokenizer
from merkleframe.session import table, written

#: Added to each count.
SMOOTH = 0.1
#: Bytes of a word that are held at once, and of the words that are.
UNIT, CHUNK = 4096, 1 << 19
BATCH = 3 << 20
#: The value of a position that no piece has reached.
UNREACHED = -1e30
#: The model is broadcast; more pieces x languages than this are an error.
MAX_MODEL = 1 << 26


def _hash(pieces: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    return A.segment_hashes(buf, np.concatenate([[0], ends[:-1]]), ends)


def _index(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """A cuckoo hash table of the pieces, and of all their beginnings, which have the id -1. -2 is free."""
    ids_of = dict(ranks)
    for p in list(ids_of):
        for n in range(1, len(p)):
            ids_of.setdefault(p[:n], -1)
    slots = 1 << max(12, (2 * len(ids_of)).bit_length())
    keys, ids = np.zeros((2, slots), np.uint64), np.full((2, slots), -2, np.int32)
    for key, piece in zip(_hash(list(ids_of)).tolist(), ids_of.values(), strict=True):
        way = 0
        for _ in range(200):
            slot = (key >> (32 * way)) & (slots - 1)
            held = int(keys[way, slot]), int(ids[way, slot])
            keys[way, slot], ids[way, slot] = key, piece
            if held[1] == -2:
                break
            (key, piece), way = held, 1 - way
        else:
            raise ValueError("the vocabulary doesn't fit the table")
    return {"keys": keys, "ids": ids, "longest": max(map(len, ranks))}


def piece_counts(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(lang, piece, n) over the given rows of (lang, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches):
        encoding = tokenizer(sent.value)
        total: dict[str, np.ndarray] = {}
        top = max(sent.value.values()) + 1
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                if lang not in total:
                    total[lang] = np.zeros(top, np.int64)
                ids = np.array(encoding.encode_ordinary(text.as_py()), np.int64)
                if len(ids) > top:
                    total[lang] += np.bincount(ids, minlength=top)
                else:
                    u, k = np.unique(ids, return_counts=True)
                    total[lang][u] += k
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "piece": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    return docs.select("lang", "text").mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Piece probabilities by language, as logarithms."""

    def __init__(self, langs: list[str], logs: np.ndarray, index: dict[str, np.ndarray]):
        self.langs, self.logs, self.index = langs, logs, index

    def _hits(self, buf: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, length and id of every piece in the segments that end at ``ends``, one after another in buf."""
        up, down = A._powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(A._BYTE[buf] * up[: len(buf)], out=total[1:])
        (keys, more_keys), (ids, more_ids) = self.index["keys"], self.index["ids"]
        mask = np.uint64(len(keys) - 1)
        begin = np.arange(len(buf), dtype=np.int32)  # of what may still become a piece
        left = (ends[owner] - begin).astype(np.int32)
        hits = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for n in range(1, self.index["longest"] + 1):
            ok = left >= n
            begin, left = begin[ok], left[ok]
            if not len(begin):
                break
            key = A.mix((total[begin + n] - total[begin]) * down[begin] + np.uint64(n))
            slot = (key & mask).astype(np.int64)
            piece = np.where(keys[slot] == key, ids[slot], np.int32(-2))
            other = np.flatnonzero(piece == -2)
            slot = ((key[other] >> np.uint64(32)) & mask).astype(np.int64)
            same = more_keys[slot] == key[other]
            piece[other[same]] = more_ids[slot[same]]
            ok = piece >= 0
            hits.append((begin[ok] + np.int32(n), np.full(int(ok.sum()), n, np.int32), piece[ok]))
            ok = piece != -2
            begin, left = begin[ok], left[ok]
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True))

    def _forward(self, buf: np.ndarray, ends: np.ndarray, back: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all positions of each segment, before its first byte and after each, in each language; and where each segment's are.

        Of segment i the first ``back[i]`` bytes have gone by already; the values of the positions up to there are ``carry``.
        """
        starts = np.concatenate([[0], ends[:-1]])
        owner = np.repeat(np.arange(len(ends)), ends - starts)
        end, n, piece = self._hits(buf, ends, owner)
        of = owner[end - 1]
        step = end - starts[of] - back[of]
        new = step > 0
        end, n, piece, of, step = end[new], n[new], piece[new], of[new], step[new]
        order = np.lexsort((of, step))
        piece, of, step = piece[order], of[order], step[order]
        to = end[order] + of  # a segment of n bytes has n + 1 positions
        origin = to - n[order]
        value = np.full((len(buf) + len(ends), len(self.langs)), UNREACHED)
        first = starts + np.arange(len(ends))
        known = np.repeat(first, back + 1) + np.arange(len(carry)) - np.repeat(np.cumsum(back + 1) - back - 1, back + 1)
        value[known] = carry
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]]) if len(step) else np.zeros(1, np.int64)
        heads = np.concatenate([[True], np.diff(to) != 0]) if len(to) else np.zeros(0, bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x = value[origin[a:b]] + self.logs[piece[a:b]]
            head = np.flatnonzero(heads[a:b])
            top = np.maximum.reduceat(x, head, axis=0)
            size = np.diff(np.append(head, b - a))
            x -= np.repeat(top, size, axis=0)
            value[to[a:b][head]] = top + np.log(np.add.reduceat(np.exp(x, out=x), head, axis=0))
        return value, first

    def word_scores(self, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihood of each word in each language, over all its segmentations; buf has the words one after another."""
        starts = np.concatenate([[0], ends[:-1]])
        out = np.zeros((len(ends), len(self.langs)))
        reach, alive = self.index["longest"], np.arange(len(ends))
        at, carry = 0, np.zeros((len(ends), len(self.langs)))
        back = np.zeros(len(ends), np.int64)
        while len(alive):
            # The next unit of each word that has one, and before it the bytes that a piece may reach back to.
            lo, hi = starts[alive] + at - back, np.minimum(starts[alive] + at + UNIT, ends[alive])
            cut = np.cumsum(hi - lo)
            part = buf[np.repeat(lo - (cut - (hi - lo)), hi - lo) + np.arange(cut[-1])]
            value, first = self._forward(part, cut, back, carry)
            last = first + (hi - lo)
            out[alive] = value[last]
            at += UNIT
            more = np.flatnonzero(ends[alive] > starts[alive] + at)
            back = np.full(len(more), min(reach - 1, at), np.int64)
            kept = np.repeat(last[more] - back, back + 1) + np.tile(np.arange(back[0] + 1), len(more)) if len(more) else more
            carry, alive = value[kept], alive[more]
        return out

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log likelihood of each text in each language."""
        starts, ends, rows = A.words(buf, offsets)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(starts):
            return out
        _, first, word = np.unique(A.segment_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        size = ends[first] - starts[first]
        # Each distinct word, with a blank before, in chunks of about as many bytes.
        score = np.zeros((len(first), len(self.langs)))
        upto = np.cumsum(size + 1)
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK, side="right")))
            word_ends = np.cumsum(size[a:b] + 1)
            source = np.repeat(starts[first[a:b]] - (word_ends - size[a:b]), size[a:b] + 1) + np.arange(word_ends[-1])
            bytes_ = buf[np.maximum(source, 0)]
            bytes_[word_ends - size[a:b] - 1] = 0x20
            score[a:b] = self.word_scores(bytes_, word_ends)
            a = b
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(rows, weights=score[word, k], minlength=len(offsets) - 1)
        return out


def train(docs: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """A model of the languages in ``docs`` (lang, text), rows without either left out."""
    ranks = load_vocabulary(vocabulary)
    counts = piece_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), "text"), ranks)
    counts = written(counts)
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    top = max(ranks.values()) + 1
    if top * len(langs) > MAX_MODEL:
        raise ValueError(f"{len(langs)} languages of {top} pieces are more than a model of {MAX_MODEL} numbers")
    n = np.zeros((top, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    for r in counts.toLocalIterator():  # pieces x languages at most
        n[r["piece"], place[r["lang"]]] = r["n"]
    return Model(langs, np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * top)), _index(ranks))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, from its text alone.

    A null text, and one without a letter, is ``und`` with score 0, as is every text if no language was learned. score is
    the prediction's share of the likelihood of all languages. Ties go to the first language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        letters = np.zeros(256, bool)
        letters[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            text = pc.fill_null(batch["text"].cast(pa.large_string()), "")
            names, scores = [], []
            for a, b in A.slices(text, BATCH):
                part = text.slice(a, b - a)
                buf, offsets = A.text_bytes(part)
                upto = np.concatenate([[0], np.cumsum(letters[buf])])
                known = upto[offsets[1:]] > upto[offsets[:-1]]
                for r in np.flatnonzero(~known):
                    known[r] = any(map(str.isalpha, part[int(r)].as_py()))
                if not m.langs:
                    known[:] = False
                s = m.scores(buf, offsets) if known.any() else np.zeros((b - a, max(1, len(m.langs))))
                best = s.argmax(axis=1)
                share = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                names += [m.langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
                scores += np.where(known, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def held_out():
    """A null doc_id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("lang", "text"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
