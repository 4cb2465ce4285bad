"""BPE of ``sentencepiece`` models: a table of the last piece of every prefix, read backwards."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from docweave.llm.tokens import joined, slices, text_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SPACE = "▁"
#: Units a worker remembers between batches, those of at most this many characters; pairs of pieces it remembers.
REMEMBERED, REMEMBERED_CHARS, REMEMBERED_PAIRS = 400_000, 64, 1_000_000
NEVER = float("-inf")


def merged(text: str, scores: dict[str, float]) -> tuple[list[str], list[tuple[float, str, str]]]:
    """The symbols of ``text`` after all merges, best score and then leftmost first, and (score, first symbol, last symbol) after each merge."""
    parts, steps = list(text), []
    while True:
        best, at = NEVER, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1], NEVER)
            if score > best:
                best, at = score, i
        if at < 0:
            return parts, steps
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        steps.append((best, parts[0], parts[-1]))


class PieceModel:
    """The vocabulary of one file: an automaton of its pieces and what a pair test needs of each.

    A pair of pieces is compatible when merging the characters of both, in the order of scores, never
    merges across the border. What happens inside a piece does not depend on its neighbours as long as
    nothing crosses its borders, so the steps of each piece are listed once, and the test walks both
    lists. A row of pieces is the encoding of its text if and only if all its neighbours are compatible.
    """

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        if library.normalize("ﬁ  x ") != SPACE + "ﬁ" + SPACE * 2 + "x" + SPACE:
            raise ValueError("only models that leave characters and spaces alone and put a space first")
        every = range(library.get_piece_size())
        self.special = {i for i in every if library.is_control(i)}
        self.bos, self.eos = library.bos_id(), library.eos_id()
        self.byte = {int(library.id_to_piece(i)[3:5], 16): i for i in every if library.is_byte(i)}
        plain = {library.id_to_piece(i): i for i in every if i not in self.special and not library.is_byte(i) and not library.is_unknown(i) and not library.is_unused(i)}
        if len(self.byte) < 256 or any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("only models with byte pieces and with spaces at the beginning of pieces")
        self.scores = {p: library.get_score(i) for p, i in plain.items()}
        self.bytes = [b""] * len(every)
        for p, i in plain.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.bytes[library.unk_id()] = " ⁇ ".encode()
        self.opens = np.zeros(len(every), bool)
        self.opens[[i for p, i in plain.items() if p.startswith(SPACE)]] = True
        letters = sorted({c for p in plain for c in p})
        self.runs = regex.compile("[" + regex.escape("".join(letters), special_only=False) + "]+|.", regex.S).findall
        self.names, self.size, self.left, self.right, self.ids = [], [], [], [], []
        self.matches = ahocorasick.Automaton()
        for p in sorted(set(plain) | set(letters)):
            parts, steps = merged(p, self.scores)
            if len(parts) > 1:
                continue  # other merges come first, so no text gets this piece
            self.matches.add_word(p, len(self.names))
            self.names.append(p)
            self.size.append(len(p))
            self.left.append([(s, f) for s, f in zip([x[0] for x in steps] + [NEVER], [p[0]] + [x[1] for x in steps])])
            self.right.append([(s, l) for s, l in zip([x[0] for x in steps] + [NEVER], [p[-1]] + [x[2] for x in steps])])
            self.ids.append([plain[p]] if p in plain else [self.byte[b] for b in p.encode()])
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def compatible(self, one: int, two: int) -> bool:
        """True when no merge crosses from piece ``one`` to piece ``two``; equal scores go from left to right."""
        a, b, i, j = self.right[one], self.left[two], 0, 0
        while True:
            (mine, last), (other, first) = a[i], b[j]
            across = self.scores.get(last + first, NEVER)
            if across > mine and across >= other and across != NEVER:
                return False
            if mine == NEVER and other == NEVER:
                return True
            if mine >= other:
                i += 1
            else:
                j += 1

    def run_ids(self, run: str) -> list[int]:
        """Ids of characters of the pieces: the one last piece of each prefix, then backwards from the end."""
        size, pairs, width = self.size, self.pairs, len(self.names)
        last = [-1] * len(run)
        for end, piece in self.matches.iter(run):
            before = end - size[piece]
            if before < 0:
                last[end] = piece
            elif last[end] < 0 and last[before] >= 0:
                pair = last[before] * width + piece
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= REMEMBERED_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(last[before], piece)
                if fits:
                    last[end] = piece
        out, at = [], len(run) - 1
        while at >= 0:
            out.extend(reversed(self.ids[last[at]]))
            at -= size[last[at]]
        return out[::-1]

    def unit_ids(self, unit: str) -> bytes:
        """Ids of a unit as little-endian unsigned 32-bit integers; a character of no piece is its bytes."""
        held = self.known.get(unit)
        if held is None:
            ids: list[int] = []
            for run in self.runs(unit):
                ids += self.run_ids(run) if run[0] in self.matches or len(run) > 1 else [self.byte[b] for b in run.encode("utf-8", "surrogatepass")]
            held = np.array(ids, "<u4").tobytes()
            if len(unit) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[unit] = held
        return held


def spaced_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, bounds, units): each text, led by a space, as units that begin with their spaces.

    No piece has a space behind another character, so units never merge with each other. A text that
    itself holds the space character is one unit; an empty text has the empty unit only.
    """
    odd, empty = pc.match_substring(texts, SPACE), pc.equal(texts, "")
    whole = pc.or_(odd, empty)
    cut = pc.split_pattern(pc.if_else(whole, pa.scalar("x", pa.large_string()), texts), " ")
    offsets = cut.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = cut.flatten().dictionary_encode()
    code, blank = coded.indices.to_numpy().astype(np.int64), pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    ends = ~blank[code] if len(code) else np.empty(0, bool)
    ends[offsets[1:] - 1] = True
    at = np.flatnonzero(ends)
    spaces = np.diff(at, prepend=-1)
    names, codes = np.unique(spaces * max(1, len(blank)) + code[at], return_inverse=True)
    words = coded.dictionary.to_pylist()
    units = [SPACE * int(n // len(words)) + words[int(n % len(words))] for n in names.tolist()]
    bounds = np.concatenate([[0], np.cumsum(ends)])[offsets]
    rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    codes[bounds[rows]] = len(units) + np.arange(len(rows))
    units += [SPACE + t.replace(" ", SPACE) if t else "" for t in texts.take(pa.array(rows)).to_pylist()]
    return codes, bounds, units


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """Loaded once per worker; the file must be there on every worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _replaced(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("docweave-each-byte", _replaced)


def texts_of(model: PieceModel, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The UTF-8 text of each stretch of ids, as the library decodes it: the first space is the one put first, bytes that are no characters are U+FFFD each."""
    data, at = joined(model.bytes, ids)
    loud = np.array([bool(x) for x in model.bytes])[ids] if len(ids) else np.empty(0, bool)
    heard = np.concatenate([[0], np.cumsum(loud)])
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        text = bytes(data[at[lo]:at[hi]])
        if heard[hi] > heard[lo]:
            first = lo + int(np.argmax(loud[lo:hi]))
            text = text[1:] if model.opens[ids[first]] else text
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode("utf-8", "docweave-each-byte").encode()
        out.append(text)
    return out


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text with begin and end ids, and ``ids`` (array of int) if asked for.

    A text is cut before its spaces. For each distinct unit of a block of texts (up to 32 MB) an automaton
    lists the pieces that end at every character; the one that is compatible with the last piece of the
    prefix before it is the last piece of this prefix, and the ids are read back from the end. That is linear in
    the unit, also for one of a million characters without a space. Ids are then decoded by the vocabulary.
    Nothing is shuffled, and a lost task repeats its own split.

    A null text is empty (begin and end only); null keys stay null; repeated rows give a row each; an
    empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_model(model)
        head, tail = (np.array([i], "<u4").tobytes() for i in (coder.bos, coder.eos))
        for batch in slices(batches):
            codes, bounds, units = spaced_units(text_of(batch))
            data, at = joined([coder.unit_ids(u) for u in units], codes)
            flat = np.frombuffer(data, "<u4", at[-1] // 4)
            starts = at[bounds]
            n = np.diff(starts) // 4 + 2
            hashes = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                one = hashlib.sha256(head)
                one.update(data[lo:hi])
                one.update(tail)
                hashes.append(one.hexdigest())
            decoded = [hashlib.sha256(t).hexdigest() for t in texts_of(coder, flat, starts // 4)]
            cols = [batch["doc_id"].cast(pa.int64()), pa.array(n), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if keep_ids:
                cols.append(pa.array([np.concatenate([[coder.bos], flat[a // 4:b // 4], [coder.eos]]).astype(np.int32) for a, b in zip(starts[:-1], starts[1:])], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    schema = SCHEMA + ", ids array<int>" * keep_ids
    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of every row's ids; control ids are silent, null ids are the empty list, ids outside the vocabulary fail the job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_model(model)
        for batch in batches:
            lists = pc.fill_null(batch["ids"], pa.scalar([], batch["ids"].type))
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = texts_of(coder, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return rows.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{ids}` as array<int>) ids").mapInArrow(run, "doc_id long, text string")
