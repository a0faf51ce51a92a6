"""Token-ID / binary output (operator 4): best-fit-decreasing packing into id matrices.

Each task tokenizes its rows and packs them in blocks of a bounded number of tokens. Documents longer than a row of the
matrix are cut into whole rows and a rest; pieces are placed longest first, each in the fullest row that still has
room. The search is by a segment tree over the capacities that are left. No token is dropped and no row is shuffled.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leafmill.llm.common import CACHED_WORDS, CACHES, cut, in_python, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
#: Token ids in a row of the matrix.
WIDTH = 2048
#: A task packs so many tokens at a time; memory is bounded by it and by the longest document.
BLOCK_TOKENS = 1 << 21
#: Fixed value: how the tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "pack_id string, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, parts array<int>, starts array<bigint>"
#: What an index row repeats of the packed row; its place is ``path`` and ``row``, and ``first`` holds in the lower 32 bits where its running ends begin, in the upper ones where its resets begin.
KEPT = ["pack_id", "n_tokens", "doc_ids", "parts", "starts"]
INDEX = "path string, row long, first long, segments int, pack_id string, n_tokens int, doc_ids array<bigint>, parts array<int>, starts array<bigint>"
#: Rows of a matrix that are read at once, at most.
READ_ROWS = 1024
#: White space as the tokenizer knows it. A run of more than 1000 is a piece of its own but for its last character, as the pattern also has it.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1001,}")


class Tokens:
    """Token ids of texts as little-endian 16-bit numbers; every id must be below 65536.

    A text is cut before its spaces, where the tokenizer's own pattern also cuts, and the ids of at most
    ``CACHED_WORDS`` such pieces are kept. Texts with two spaces in a row or a space at the end go to the tokenizer whole.
    """

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.by_piece = _Pieces(self.encoder)

    def encode(self, text: str | None) -> bytes:
        out, at = [], 0
        for run in LONG_SPACE.finditer(text or ""):
            end = run.end() - (run.end() < len(text))
            out += [self._encode(text[at : run.start()]), np.array(self.encoder._encode_single_piece(text[run.start() : end]), "<u2").tobytes()]
            at = end
        return b"".join([*out, self._encode((text or "")[at:])])

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[-1] == " ":
            return np.array(self.encoder.encode_ordinary(text), "<u2").tobytes()
        first, *rest = text.split(" ")
        ids = np.array(self.encoder.encode_ordinary(first), "<u2").tobytes()
        return ids + b"".join(map(self.by_piece.__getitem__, rest))

    def decode(self, ids: np.ndarray) -> str:
        return self.encoder.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")


class _Pieces(dict):
    def __init__(self, encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        value = np.array(self.encoder.encode_ordinary(" " + piece), "<u2").tobytes()
        if len(self) < CACHED_WORDS:
            self[piece] = value
        return value


class Capacities:
    """Rows by the room they have left; finds the smallest room that is at least a given one in O(log width)."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.tree = bytearray(2 * self.leaves)  # whether any row is below a node
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        held = self.rows.setdefault(room, [])
        held.append(row)
        node = room + self.leaves
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row with room for ``need``, which is taken out; None if no row has it."""
        node, tree = need + self.leaves, self.tree
        if not tree[node]:
            # up until a right neighbour holds rows, then down its leftmost path
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node and not (node < self.leaves and (tree[2 * node] or tree[2 * node + 1])):
                tree[node] = 0
                node >>= 1
        return room, row


def pack(lengths: list[int], width: int) -> list[list[int]]:
    """Best fit, longest first: the pieces of each row, in the order in which they were placed."""
    free, rows = Capacities(width), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        found = free.take(n)
        room, row = found or (width, len(rows))
        if not found:
            rows.append([])
        rows[row].append(k)
        if room > n:
            free.put(room - n, row)
    return rows


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, width: int = WIDTH, end: int = END_OF_TEXT) -> DataFrame:
    """Rows of at most ``width`` token ids packed from ``doc_id, text``.

    ``input_ids``: the row's ids, little-endian uint16. ``cu_seqlens``: 0 and the running ends of the segments.
    ``position_ids``: little-endian uint16 from 0 again in each segment. ``doc_ids``, ``parts``, ``starts``: a
    segment's document, which of its parts it is, and the offset of its first token in the document. ``pack_id`` is
    unique. Each document's ids are followed by ``end``; null and empty texts are ``end`` alone. A document's parts
    joined by number give its ids back. Repeated rows are packed each; null ids stay null; an empty table has no rows;
    other columns are dropped.
    """
    if not 0 < width < 1 << 16:
        raise ValueError("width must be below 65536, as positions have 16 bits")

    def block(held: list[tuple[int | None, np.ndarray]], name: str) -> pa.RecordBatch:
        parts = [(doc, k // width, k, ids[k : k + width]) for doc, ids in held for k in range(0, len(ids), width)]
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for n, row in enumerate(pack([len(p[3]) for p in parts], width)):
            own = [parts[k] for k in row]
            sizes = [len(p[3]) for p in own]
            out["pack_id"].append(f"{name}-{n}")
            out["n_tokens"].append(sum(sizes))
            out["input_ids"].append(b"".join([p[3].tobytes() for p in own]))
            out["cu_seqlens"].append(np.cumsum([0, *sizes]).tolist())
            out["position_ids"].append(np.concatenate([_POSITIONS[:k] for k in sizes]).tobytes())
            for c, k in (("doc_ids", 0), ("parts", 1), ("starts", 2)):
                out[c].append([p[k] for p in own])
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _TOKENS.get(vocabulary) or _TOKENS.setdefault(vocabulary, Tokens(vocabulary))
        task = TaskContext.get().partitionId()
        stop, held, total, n = np.array([end], "<u2").tobytes(), [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(tokens.encode(text.as_py()) + stop, "<u2")
                held.append((doc, ids))
                total += len(ids)
                if total >= BLOCK_TOKENS:
                    yield block(held, f"{task}-{n}")
                    held, total, n = [], 0, n + 1
        if held:
            yield block(held, f"{task}-{n}")

    return in_python(docs.select(docs["doc_id"].cast("long"), "text"), run, SCHEMA)


_TOKENS: dict[str, Tokens] = {}
CACHES.append(_TOKENS)
_POSITIONS = np.arange(1 << 16, dtype="<u2")


def write_matrices(packed: DataFrame, folder: str | None = None, width: int = WIDTH, pad: int = END_OF_TEXT) -> DataFrame:
    """Writes ``packed`` as binary id matrices, one for each task, and returns the index of their rows, columns ``INDEX``.

    ``path`` holds rows of ``width`` little-endian uint16 ids, the unused end of a row filled with ``pad``. ``path + ".cu"`` holds
    0 and the running ends of each row's segments, and ``path + ".resets"`` the offsets, counted in ids from the
    beginning of the matrix, at which positions begin at 0 again, both as little-endian int64; ``first`` and ``segments``
    say which of them are a row's. Files go to the shared folder by default. A task that runs again writes files of another
    name, and the index names those of the run that counts. An empty table gives an empty index.
    """
    folder = folder or f"{shared_dir(packed.sparkSession)}/matrices-{uuid.uuid4().hex}"
    uri = folder.split("://")[0] + "://" if "://" in folder else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, store, files, row, first = TaskContext.get(), None, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if store is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                path = f"{base}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
                files = [store.open_output_stream(path + end, compression=None) for end in ("", ".cu", ".resets")]
            made: list[list] = [[], []]
            for ids, cu in zip(batch.column("input_ids"), batch.column("cu_seqlens")):
                ids, cu = ids.as_buffer(), np.array(cu.as_py(), "<i8")
                begins = cu if cu[-1] < width else cu[:-1]  # the filling begins at 0 too
                files[0].write(ids)
                files[0].write(np.full(width - ids.size // 2, pad, "<u2").tobytes())
                files[1].write(cu.tobytes())
                files[2].write((begins + row * width).tobytes())
                made[0].append(first)
                made[1].append(len(cu) - 1)
                first += len(cu) + (len(begins) << 32)
                row += 1
            rows = pa.array(range(row - batch.num_rows, row), pa.int64())
            own = [pa.array([uri + path] * batch.num_rows), rows, pa.array(made[0], pa.int64()), pa.array(made[1], pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(c) for c in KEPT)], names=["path", "row", "first", "segments", *KEPT])
        for f in files:
            f.close()

    return cut(in_python(packed.select("input_ids", "cu_seqlens", *KEPT), run, INDEX))


def read_matrices(index: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows, columns ``SCHEMA``, of an index of ``write_matrices``, read back from the files; ranges of rows are one read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, READ_ROWS) for b in batches for k in range(0, b.num_rows, READ_ROWS)):
            paths = batch.column("path").to_pylist()
            begins = [k for k in range(len(paths)) if not k or paths[k] != paths[k - 1]]
            for a, b in zip(begins, [*begins[1:], len(paths)]):
                yield read(batch.slice(a, b - a), paths[a])

    def read(part: pa.RecordBatch, path: str) -> pa.RecordBatch:
        rows, first, segments, used = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "first", "segments", "n_tokens"))
        store, path = fs.FileSystem.from_uri(path)
        low, high = int(rows.min()), int(rows.max()) + 1
        with store.open_input_file(path) as f:
            ids = np.frombuffer(f.read_at((high - low) * width * 2, low * width * 2), "<u2").reshape(-1, width)
        ends, resets = first & (1 << 32) - 1, first >> 32
        count = segments + (used < width)
        with store.open_input_file(path + ".cu") as f:
            e0 = int(ends.min())
            cu = np.frombuffer(f.read_at(8 * (int((ends + segments).max()) + 1 - e0), 8 * e0), "<i8")
        with store.open_input_file(path + ".resets") as f:
            r0 = int(resets.min())
            zero = np.frombuffer(f.read_at(8 * (int((resets + count).max()) - r0), 8 * r0), "<i8")
        out: list[list] = [[], [], []]
        for row, n, e, r, k, c in zip(rows, used, ends - e0, resets - r0, segments, count):
            out[0].append(ids[row - low, :n].tobytes())
            out[1].append(cu[e : e + k + 1].tolist())
            begin = zero[r : r + c] - row * width
            sizes = np.diff(np.append(begin, width))
            out[2].append((_POSITIONS[:width] - np.repeat(begin, sizes).astype("<u2"))[:n].tobytes())
        arrays = dict(zip(("input_ids", "cu_seqlens", "position_ids"), (pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.list_(pa.int32()), pa.binary())))))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([arrays.get(c) if c in arrays else part.column(c) for c in names], names=names)

    return in_python(index, run, SCHEMA)
