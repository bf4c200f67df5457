"""Language identification by cross-parsing against suffix automata.

Per language, a suffix automaton of labelled text recognises every substring of
it.  A text is cross-parsed greedily: each phrase is the longest match that the
automaton allows from where the last one ended.  Text in the automaton's
language needs few phrases; the language that needs the fewest, normalised by
the length of what it was trained on, wins.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, release_memory, slices, unused

#: What separates words, and a letter that no labelled text has; codes of the letters seen use the symbols after these.
BREAK, OTHER = 0, 1
#: Symbols of an alphabet, and how many of them are left for letters that take several.
ALPHABET, DIGITS = 64, 32
#: Parts of a text that are parsed at once; their phrases are joined to those of the whole text.
BLOCK = 1024
#: Symbols parsed in one go by a task, over all languages.
CHUNK = 32_000_000
NO_LETTER = "und"
#: Marks a transition that starts a phrase.
_FLAG = np.int32(1 << 30)


def letter_codes(counts: dict[str, int]) -> np.ndarray:
    """Symbols of each code point, most significant first, 0 before and after them for short ones (0x110000 x length).

    Each letter has a code of its own: one symbol for the commonest, and where an
    alphabet has no room for all, several digits for each of the others.
    """
    common = sorted(counts, key=lambda c: (-counts[c], c))
    single = common if len(common) <= ALPHABET - 2 else common[: ALPHABET - DIGITS - 2]
    others, length = sorted(set(common) - {*single}), 1
    while others and DIGITS**length < len(others):
        length += 1
    codes = np.zeros((0x110000, length), np.uint8)
    codes[[c for c in range(0x110000) if chr(c).isalpha()], 0] = OTHER
    for k, c in enumerate(sorted(single)):
        codes[ord(c), 0] = k + 2
    for k, c in enumerate(others):
        codes[ord(c)] = [ALPHABET - DIGITS + k // DIGITS**i % DIGITS for i in reversed(range(length))]
    return codes


def symbols(text: str, codes: np.ndarray) -> np.ndarray:
    """Lower-case text as symbols: a run of what isn't a letter is one break."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    got = codes[points, 0]
    keep = np.concatenate(([True], (got[1:] != BREAK) | (got[:-1] != BREAK)))[: len(got)]
    if codes.shape[1] == 1:
        return got[keep]
    each = codes[points[keep]]
    used = each != BREAK
    used[:, 0] = True
    return each[used]


@dataclass
class CrossParser:
    """Automata of all languages in one transition table.

    ``table[s, c]`` is the state after symbol ``c`` in state ``s``; where a phrase
    starts with ``c``, as no match goes on, it has a flag.
    """

    languages: list[str]
    codes: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    trained: np.ndarray

    def symbols(self, text: str) -> np.ndarray:
        return symbols(text, self.codes)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text for each language (texts x languages), greedily from its start.

        All blocks are parsed at once as if a phrase started with each.  A block's
        phrases truly start where the last one of the block before ends;
        from there it is parsed until the two parses meet in a phrase, after which they agree.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        blocks = lengths // BLOCK + 1  # what pads the last one ends its text
        last = np.cumsum(blocks)
        owner = np.repeat(np.arange(len(texts)), blocks)
        rows, kinds = len(owner), len(self.languages)
        flat = np.full(rows * BLOCK, OTHER, np.uint8)
        for t, end, n, k in zip(texts, last, lengths, blocks, strict=True):
            flat[(end - k) * BLOCK : (end - k) * BLOCK + n] = t
        begin = np.arange(rows) * BLOCK
        size = np.full(rows, BLOCK)
        size[last - 1] = lengths % BLOCK
        # the fullest blocks first, so that a step works on those that reach it
        order = np.argsort(-size, kind="stable")
        rank = np.empty(rows, np.int64)
        rank[order] = np.arange(rows)
        steps = np.ascontiguousarray(flat.reshape(rows, BLOCK)[order].T)
        live = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")
        # a number for each phrase of a block, from 1 on, where it starts
        number, total = np.zeros((BLOCK, kinds, rows), np.int16), np.zeros((kinds, rows), np.int16)
        state = np.repeat(self.roots[:, None], rows, axis=1).astype(np.int32)
        table, width = self.table.reshape(-1), self.table.shape[1]
        for i in range(int(size.max())):
            n = live[i]
            to = table.take(state[:, :n] * width + steps[i, :n])
            new = to >= _FLAG
            total[:, :n] += new
            np.multiply(total[:, :n], new, out=number[i, :, :n])
            state[:, :n] = to & (_FLAG - 1)
        total = total.astype(np.int64)

        def follow(kind, at, state, row, until):
            """Parse on in some languages and blocks until a phrase starts that ``until`` accepts: phrases before it, and its place."""
            count, stop, lane = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
            while len(lane):
                to = table.take(state * width + flat.take(at))
                new = np.flatnonzero(to >> 30)
                done = until(kind[new], at[new], row[new])
                count[lane[new[~done]]] += 1
                state = to & (_FLAG - 1)
                if done.any():
                    stop[lane[new[done]]] = at[new[done]]
                    rest = np.ones(len(lane), bool)
                    rest[new[done]] = False
                    kind, at, state, row, lane = kind[rest], at[rest], state[rest], row[rest], lane[rest]
                at = at + 1
            return count, stop

        kind, row = np.divmod(np.arange(kinds * rows), rows)
        count = total[:, rank].reshape(-1)
        whole = count.copy()
        _, stop = follow(kind, (begin + size)[row], state[:, rank].reshape(-1), row, lambda k, at, r: np.ones(len(at), bool))
        leave, entry = stop.copy(), begin[row]
        inner = np.ones(rows, bool)
        inner[last - blocks] = False
        met = lambda k, at: number[at % BLOCK, k, rank[at // BLOCK]]
        again = np.flatnonzero(inner[row])
        while len(again):
            # blocks whose entry has changed; the block before may still change itself
            again = again[entry[again] != stop[again - 1]]
            entry[again] = stop[again - 1]
            finish = begin[row[again]] + size[row[again]]
            inside, beyond = again[entry[again] < finish], again[entry[again] >= finish]
            count[beyond], stop[beyond] = 0, entry[beyond]
            k, r = kind[inside], row[inside]
            some, place = follow(k, entry[inside], self.roots[k].astype(np.int32), r, lambda k, at, r: (at >= begin[r] + size[r]) | (met(k, at) > 0))
            joined = place < begin[r] + size[r]
            same = met(k, np.where(joined, place, begin[r]))
            count[inside] = some + np.where(joined, whole[inside] - same + 1, 0)
            stop[inside] = np.where(joined, leave[inside], place)
            again = again + 1
            again = again[again < len(row)]
            again = again[inner[row[again]]]
        found = np.zeros((len(texts), kinds), np.int64)
        for k in range(kinds):
            found[:, k] = np.bincount(owner, weights=count[k * rows : (k + 1) * rows], minlength=len(texts))
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = [NO_LETTER] * len(texts), np.zeros(len(texts))
        weights = np.log(self.trained + 2)
        for a, b in slices([len(t or "") for t in texts], CHUNK // len(self.languages)):
            part = [(i, s) for i, s in ((i, self.symbols(texts[i])) for i in range(a, b) if texts[i]) if s.any()]
            if not part:
                continue
            cost = self.phrases([s for _, s in part]) * weights
            best = cost.argmin(axis=1)
            if len(self.languages) > 1:
                least, second = np.partition(cost, 1, axis=1)[:, :2].T
                sure = second / (least + second)
            else:
                sure = np.ones(len(part))
            for (i, _), k, s in zip(part, best, sure, strict=True):
                names[i], scores[i] = self.languages[k], s
        return names, scores


def suffix_automaton(text: np.ndarray, width: int = ALPHABET) -> np.ndarray:
    """Transitions (states x symbols, -1 for none) of the automaton of all substrings of ``text``."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new, p = len(go), last
        go.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # q also ends longer matches: the shorter ones get a state of their own
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(go), width), -1, np.int32)
    for s, out in enumerate(go):
        for c, t in out.items():
            table[s, c] = t
    return table


def train(samples: dict[str, list[str]]) -> CrossParser:
    """Automata of each language's sample of whole texts."""
    codes = letter_codes(Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()))
    names, width = sorted(samples), int(codes.max()) + 1
    tables, roots, trained, base = [np.zeros((0, width), np.int32)], [], [], 0
    for name in names:
        text = np.concatenate([np.append(symbols(t, codes), np.uint8(BREAK)) for t in samples[name] if t] or [np.zeros(0, np.uint8)])
        table = suffix_automaton(text, width)
        start = np.where(table[0] >= 0, table[0], 0)
        done = np.where(table >= 0, table + base, (start + base) | _FLAG)
        done[0] = (start + base) | _FLAG  # a phrase starts; a symbol that the language lacks is a phrase of its own
        tables.append(done.astype(np.int32))
        roots.append(base)
        trained.append(len(text))
        base += len(table)
    if base * width >= 1 << 31:
        raise ValueError("too much labelled text for one table: lower max_docs or max_chars")
    return CrossParser(names, codes, np.concatenate(tables), np.array(roots, np.int32), np.array(trained))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 24, max_chars: int = 8_192) -> CrossParser:
    """Train on a bounded sample: per language ``max_docs`` whole labelled texts.

    These are the ones of least id hash among the texts of at most ``max_chars``
    characters; a language with longer texts only is learned from its shortest
    one.  The rank limit is applied before the shuffle, so a language with most
    of the rows sends a few documents per task.
    """
    order = Window.partitionBy("lang").orderBy("beyond", "h", "text")
    text = F.col(text_col)
    rows = (
        docs.filter(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
        .select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(id_col).alias("h"), F.greatest(F.length(text) - max_chars, F.lit(0)).alias("beyond"))
        .withColumn("n", F.row_number().over(order))
        .filter((F.col("n") <= max_docs) & ((F.col("beyond") == 0) | (F.col("n") == 1)))
        .select("lang", "n", "text")
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        samples.setdefault(r.lang, []).append(r.text)
    return train(samples)


def identify(docs: DataFrame, parser: CrossParser, *, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1; a half and more for the winner).

    The whole text is parsed, however long.  Null, empty and letterless texts get
    ``und`` and score 0; ties go to the language first in code-point order; with
    no labelled language at all everything is ``und``.  Repeated rows are scored
    alike; an empty table gives an empty result; existing columns of the two names
    are replaced, all others kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by languages x max_docs x max_chars

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        found = model.value
        if not found.languages:
            return pd.DataFrame({"lang_pred": [NO_LETTER] * len(texts), "score": np.zeros(len(texts))})
        names, scores = found.predict(list(texts))
        release_memory()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    name = unused(docs, "found")
    # declared so that a filter on the result doesn't make Spark run it twice
    return docs.select(*kept, guess.asNondeterministic()(F.col(text_col)).alias(name)).select(*kept, f"{name}.lang_pred", f"{name}.score")


def fit_and_identify(docs: DataFrame, *, folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """Learn from documents whose id's CRC-32 mod ``folds`` isn't ``held_out``; identify all.

    Returns the columns of ``docs`` plus ``held_out``, ``lang_pred``, ``score``.
    """
    apart = id_crc(F.col(options.get("id_col", "doc_id"))) % folds == held_out
    parser = fit(docs.filter(~apart), **options)
    return identify(docs.withColumn("held_out", apart), parser, text_col=options.get("text_col", "text"))
