"""Language ID by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text is built per language. A text is parsed against each
automaton into its longest matches; c phrases from n labelled characters cost c * log2(n) bits, and the language
with the fewest bits a character wins.

Scale: the sample is bounded by language, and every text is parsed whole where it lies, with no shuffle. Texts are
parsed in pieces of CHUNK characters side by side, one numpy step for a column of pieces in all languages; where a
piece goes on from another, both ways of parsing it are followed until they meet, so the phrases are those of the
whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_batches, sliced, text_or_empty, worker_copy

#: Bound of the labelled sample: characters a language.
LANGUAGE_CHARS = 30_000
CHUNK, SIDE_BY_SIDE = 1024, 4096
#: Cells of the dense table, of 4 bytes.
DENSE_CELLS = 8 << 20
#: Bits of a state's number; a transition's key has the others.
STATE_BITS = 26
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(labelled: DataFrame, language_chars: int = LANGUAGE_CHARS) -> list[tuple[str, str]]:
    """(lang, text) pairs, sorted: distinct texts of the smallest hashes, language_chars characters of each language.

    A hash's leading zeros halve the texts with each step, so a histogram of 63 rows a language tells which texts to
    fetch; copies count once. Of a longer text the sample takes language_chars characters.
    """
    h = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", h.alias("h"))
    rows = rows.withColumn("zeros", 62 - F.length(F.bin("h"))).withColumn("len", F.least(F.length("text"), F.lit(language_chars)))
    hist: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("lang", "h", "zeros").agg(F.max("len").alias("len")).groupBy("lang", "zeros").agg(F.sum("len").alias("chars")).collect():
        hist.setdefault(r["lang"], {})[r["zeros"]] = r["chars"]
    if not hist:
        return []
    least = {}
    for lang, chars in hist.items():
        least[lang], total = 0, 0
        for z in sorted(chars, reverse=True):
            total += chars[z]
            if total >= language_chars:
                least[lang] = z
                break
    wanted = F.create_map(*[F.lit(x) for kv in sorted(least.items()) for x in kv])
    # about twice the bound a language
    found = rows.where(F.col("zeros") >= wanted[F.col("lang")]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, language_chars)).alias("text"))
    taken, out = Counter(), []
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"])):
        if taken[r["lang"]] < language_chars:
            out.append((r["lang"], r["text"][: language_chars - taken[r["lang"]]]))
            taken[r["lang"]] += len(out[-1][1])
    return out


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton that accepts every substring of text; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for ch in text:
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p, last = len(step) - 1, last, len(step) - 1
        while p >= 0 and ch not in step[p]:
            step[p][ch] = new
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                copy = len(step) - 1
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = copy
                    p = link[p]
                link[q] = link[new] = copy
    return step


def letters_only(text: str) -> str:
    """Lower case, each run of other characters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Transitions:
    """Transitions of the automata: open addressing over (state, letter), looked up for many states at a time."""

    def __init__(self, keys: np.ndarray, to: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        #: a key and its target in one long, -1 where there is none
        self.cells = np.full(1 << bits, -1, np.int64)
        cells, at, left = keys << STATE_BITS | to, self._home(keys), np.arange(len(keys))
        while len(left):  # of those that want a place, the last written has it and the others go on
            free = left[self.cells[at[left]] < 0]
            self.cells[at[free]] = cells[free]
            left = left[self.cells[at[left]] != cells[left]]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Targets, -1 where there is none."""
        at = self._home(keys)
        got = self.cells.take(at, mode="clip")
        other = (got >> STATE_BITS) != keys
        out = got & ((1 << STATE_BITS) - 1)
        if len(left := np.flatnonzero(other)):
            out[left] = -1
            left = left[got[left] >= 0]
            at = at[left]
            while len(left):
                at = (at + 1) & self.mask
                got = self.cells.take(at, mode="clip")
                hit = (got >> STATE_BITS) == keys[left]
                out[left[hit]] = got[hit] & ((1 << STATE_BITS) - 1)
                go = ~hit & (got >= 0)
                left, at = left[go], at[go]
        return out


class Parser:
    """Automata of all languages; class 0 is the space, the last class a letter that none has."""

    def __init__(self, sample: tuple[tuple[str, str], ...]) -> None:
        texts: dict[str, list[str]] = {}
        for lang, text in sample:
            texts.setdefault(lang, []).append(letters_only(text))
        joined = {lang: " ".join(t) for lang, t in sorted(texts.items()) if any(t)}
        self.langs = list(joined)
        letters = [c for c, _ in sorted(Counter("".join(joined.values()).replace(" ", "")).items(), key=lambda x: (-x[1], x[0]))]
        self.width = len(letters) + 2
        self.bits = np.array([math.log2(len(t) + 2) for t in joined.values()])
        cls = {" ": 0} | {c: k + 1 for k, c in enumerate(letters)}
        #: the start states, and the state after one letter from there: the start itself if the language lacks it
        self.root = np.zeros(len(joined), np.int32)
        self.first = np.zeros((len(joined), self.width), np.int32)
        keys, to, states = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for n, text in enumerate(joined.values()):
            steps = suffix_automaton(text)
            self.root[n] = self.first[n] = states
            for c, target in steps[0].items():
                self.first[n, cls[c]] = states + target
            size = sum(map(len, steps))
            keys.append(np.fromiter(((states + k) * self.width + cls[c] for k, step in enumerate(steps) for c in step), np.int64, size))
            to.append(np.fromiter((states + t for step in steps for t in step.values()), np.int64, size))
            states += len(steps)
        if states * self.width >> 63 - STATE_BITS or states >> STATE_BITS:
            raise ValueError("the labelled sample is too large: lower language_chars")
        keys, to = np.concatenate(keys), np.concatenate(to)
        #: the commonest letters have a dense table, the others open addressing
        self.n_dense = max(1, min(self.width, DENSE_CELLS // max(1, states)))
        self.dense = np.full(states * self.n_dense, -1, np.int32)
        often = keys % self.width < self.n_dense
        self.dense[keys[often] // self.width * self.n_dense + keys[often] % self.width] = to[often]
        self.table = Transitions(keys[~often], to[~often])
        self.code = np.zeros(0x110000, np.uint16 if self.width < 1 << 16 else np.uint32)
        self.code[[k for k in range(0x110000) if chr(k).isalpha()]] = self.width - 1
        for c, k in cls.items():
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.code[ord(form)] = k

    def classes(self, text: str) -> np.ndarray:
        code = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = code == 0
        return code[~(space & np.concatenate(([True], space[:-1])))] if len(code) else code

    def _step(self, lang: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading c, and where a new phrase began."""
        if self.n_dense < self.width and len(rare := np.flatnonzero(c >= self.n_dense)):
            to = self.dense.take(state * self.n_dense + np.minimum(c, self.n_dense - 1), mode="clip")
            to[rare] = self.table.find(state[rare].astype(np.int64) * self.width + c[rare])
        else:
            to = self.dense.take(state * self.n_dense + c, mode="clip")
        miss = to < 0
        if len(at := np.flatnonzero(miss)):
            to[at] = self.first.take(lang[at] * self.width + c[at], mode="clip")
        return to, miss

    def phrases(self, pieces: list[np.ndarray], before: list[int], begin: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases begin in each piece by each language, but for one at its start, and the states at its end:
        [languages, pieces]. Piece k goes on from piece before[k], or from the states begin[k]; else it starts anew (-1)."""
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        lengths, n_lang = np.array([len(p) for p in pieces])[order], len(self.langs)
        codes = np.zeros((lengths[0], len(pieces)), np.int32)
        for k, j in enumerate(order.tolist()):
            codes[: len(pieces[j]), k] = pieces[j]
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        count = np.zeros((n_lang, len(pieces)), np.int64)
        state = np.repeat(self.root[:, None], len(pieces), axis=1)
        active = len(pieces) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        for j in range(lengths[0]):
            n = active[j]
            if not j or n != active[j - 1]:
                lang = np.repeat(np.arange(n_lang), n)
            to, miss = self._step(lang, state[:, :n].ravel(), np.tile(codes[j, :n], n_lang))
            state[:, :n] = to.reshape(n_lang, n)
            count[:, :n] += miss.reshape(n_lang, n)

        # all pieces were parsed from the start state: follow both parses of a piece until they meet
        back, after = np.full(len(pieces), -1, np.int64), np.full(len(pieces), -1, np.int64)
        given = np.repeat(self.root[:, None], len(pieces), axis=1)
        for k, b in enumerate(before):
            if b >= 0:
                back[place[k]], after[place[b]] = place[b], place[k]
            elif k in begin:
                given[:, place[k]] = begin[k]
        shift, alone = np.zeros_like(count), state.copy()
        todo = np.flatnonzero((back >= 0) | (given != self.root[:, None]).any(axis=0))
        lang, piece = np.repeat(np.arange(n_lang), len(todo)), np.tile(todo, n_lang)
        while len(piece):
            plain, going = self.root[lang], np.where(back[piece] >= 0, state[lang, back[piece]], given[lang, piece])
            shift[lang, piece] = 0
            changed: list[tuple[np.ndarray, np.ndarray]] = []
            j = 0
            while len(piece):
                # where they have met the piece ends as it did alone
                met, over = plain == going, lengths[piece] <= j
                if (stop := met | over).any():
                    l, p, end = lang[stop], piece[stop], np.where(met, alone[lang, piece], going)[stop]
                    new = state[l, p] != end
                    state[l, p] = end
                    changed.append((l[new], after[p[new]]))
                    lang, piece, plain, going = lang[~stop], piece[~stop], plain[~stop], going[~stop]
                c = codes[j, piece] if len(piece) else piece
                plain, m1 = self._step(lang, plain, c)
                going, m2 = self._step(lang, going, c)
                shift[lang, piece] += m2.astype(np.int64) - m1
                j += 1
            lang, piece = (np.concatenate([x[k] for x in changed]) for k in (0, 1))
            lang, piece = lang[piece >= 0], piece[piece >= 0]
        return (count + shift)[:, place], state[:, place]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is by how much the best beats the next: 1 - best / next."""
        total, chars = np.ones((len(self.langs), len(texts))), np.zeros(len(texts))
        waiting: list[tuple[int, np.ndarray]] = []
        states: dict[int, np.ndarray] = {}

        def parse() -> None:
            if waiting and self.langs:
                before = [k - 1 if k and waiting[k - 1][0] == text else -1 for k, (text, _) in enumerate(waiting)]
                begin = {0: states[waiting[0][0]]} if waiting[0][0] in states else {}
                found, end = self.phrases([p for _, p in waiting], before, begin)
                np.add.at(total, (slice(None), [k for k, _ in waiting]), found)
                states.clear()
                states[waiting[-1][0]] = end[:, -1]
            waiting.clear()

        for k, text in enumerate(texts):
            gap = False
            for start in range(0, len(text), 1 << 20):  # a bounded copy of long texts at a time
                code = self.classes(text[start : start + (1 << 20)])
                code = code[1:] if gap and len(code) and code[0] == 0 else code
                gap = bool(len(code)) and code[-1] == 0 or gap and not len(code)
                chars[k] += np.count_nonzero(code)
                for a in range(0, len(code), CHUNK):
                    waiting.append((k, code[a : a + CHUNK]))
                    if len(waiting) >= SIDE_BY_SIDE:
                        parse()
        parse()
        out = []
        for k in range(len(texts)):
            if not chars[k] or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            cost = total[:, k] * self.bits
            best = int(cost.argmin())
            rest = np.delete(cost, best)
            out.append((self.langs[best], float(1 - cost[best] / rest.min()) if len(rest) else 1.0))
        return out


def identify(docs: DataFrame, sample: list[tuple[str, str]]) -> DataFrame:
    """docs with lang_pred and score added, which only its text decides.

    lang_pred is `und` and score 0 for null text, text without a letter, or an empty sample. docs must not have
    columns of these names. Ties go to the first language by name. Repeated rows get the same answer, an empty table none.
    """
    frozen = tuple(sample)
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(frozen)  # LANGUAGE_CHARS characters a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_copy(Parser, shared.value)
        for batch in sliced(batches, 1024):
            found = parser.predict([x or "" for x in batch.column("text").to_pylist()])
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "lang_pred", "score"])

    return map_batches(docs, run, schema)


def keep_identified(docs: DataFrame, sample: list[tuple[str, str]]) -> DataFrame:
    """The rows of docs(text, lang) whose language is identified, with a null lang filled in; all columns stay.

    Rows without a letter (null, empty) go. Repeated rows are judged alike; texts of any length are read whole; an empty table gives
    none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_copy(Parser, shared.value)
        for batch in sliced(batches, 1024):
            found = [f[0] for f in parser.predict([x or "" for x in batch.column("text").to_pylist()])]
            at = batch.schema.get_field_index("lang")
            lang = batch.column(at)
            filled = pa.array([x if x is not None else f for x, f in zip(lang.to_pylist(), found)], lang.type)
            yield batch.set_column(at, batch.schema.field(at), filled).filter(pa.array([f != UNKNOWN for f in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    sample = labelled_sample(docs.where(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", text_or_empty().alias("text"), held_out().alias("held_out")), sample).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
