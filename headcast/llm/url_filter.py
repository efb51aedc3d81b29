"""URL rules as one bit-parallel wildcard automaton over canonical URLs.

All rules lie side by side in machine words, one bit per place in a rule. Reading a byte moves every place whose next
symbol accepts it (Shift-And) and keeps the places that stand at a wildcard. A batch of URLs is simulated together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Between host and path of a canonical URL; neither wildcard of a host crosses it.
BORDER = 0


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``. ``*`` stands for any run of bytes within its part."""

    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def symbols(self) -> list[int | str]:
        """Bytes and wildcards: ``h`` stays within the host, ``*`` doesn't care."""
        host: list[int | str] = ["h" if b == ord("*") else b for b in self.host.encode("utf-8")]
        path: list[int | str] = ["*" if b == ord("*") else b for b in self.path.encode("utf-8")]
        return ["h", ord("."), *host, BORDER, *path, "*"]


class GlobAutomaton:
    """Masks of all rules; ``matches`` gives for each input the rules that accept it whole."""

    def __init__(self, rules: Sequence[Sequence[int | str]]):
        start, bits = [], 0
        accepts = []
        for symbols in rules:
            start.append(bits)
            bits += sum(isinstance(s, int) for s in symbols)
            accepts.append(bits)
            bits += 1
        self.words = max(1, (bits + 63) // 64)
        step = np.zeros((256, self.words), dtype=np.uint64)
        stay = np.zeros((256, self.words), dtype=np.uint64)
        self.first = np.zeros(self.words, dtype=np.uint64)
        for symbols, at in zip(rules, start, strict=True):
            self.first[at >> 6] |= np.uint64(1 << (at & 63))
            for s in symbols:
                word, bit = at >> 6, np.uint64(1 << (at & 63))
                if isinstance(s, int):
                    step[s, word] |= bit
                    at += 1
                else:
                    stay[:, word] |= bit
                    if s == "h":
                        stay[BORDER, word] &= ~bit
        self.step, self.stay = step, stay
        self.accept = [(a >> 6, np.uint64(1 << (a & 63))) for a in accepts]

    def matches(self, inputs: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: inputs by rules."""
        n = len(inputs)
        lengths = np.fromiter(map(len, inputs), dtype=np.int64, count=n)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(inputs), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        ends = lengths[order]
        live = np.repeat(self.first[None, :], n, axis=0)
        for at in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-ends, -at, side="left"))  # the inputs longer than ``at``
            byte = data[begin[:m] + at]
            moved = live[:m] & self.step[byte]
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            live[:m] = shifted | live[:m] & self.stay[byte]
        out = np.zeros((n, len(self.accept)), dtype=bool)
        for rule, (word, bit) in enumerate(self.accept):
            out[order, rule] = (live[:, word] & bit) != 0
        return out


UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def host_and_path(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    begin = -1 if url is None else url.find(b"://")
    if begin < 0:
        return b"", b""
    rest = url[begin + 3 :]
    cut = min((i for i in (rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find(b"/")
    slash = len(rest) if slash < 0 else slash
    return rest[:slash].translate(UPPER_TO_LOWER), rest[slash:]


def judge_urls(
    df: DataFrame, rules: Sequence[Rule], block_globs: Sequence[str] = (), url_col: str = "url", keep: Sequence[str] = ("page_id",), slice_rows: int = 4096
) -> DataFrame:
    """Host, path, the longest fitting rule and a verdict for each URL.

    Adds ``host`` and ``path`` (strings, empty without ``://`` or for null), ``rule`` (text of the longest fitting rule,
    the first in text order among equally long ones; null if none fits) and ``verdict``: the rule's action, else
    ``block`` if host and path match one of ``block_globs`` (``*`` is any run), else ``allow``. Repeated rows give
    repeated rows, an empty table an empty table; columns outside ``keep`` are dropped. Rules are parameters of the
    call, so their masks are small; ``slice_rows`` bounds the rows simulated at once.
    """
    rules = sorted(rules, key=lambda r: (-len(r.text), r.text))
    globs = [["*" if b == ord("*") else b for b in g.encode("utf-8")] for g in block_globs]
    names = [("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType())]
    kept = [c for c in dict.fromkeys(keep) if c not in {n for n, _ in names}]
    inner = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url_col}`").cast("string").cast("binary").alias("__headcast_url"))
    schema = T.StructType([inner.schema[c] for c in kept] + [T.StructField(n, t, True) for n, t in names])
    n_rules = len(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_rules = GlobAutomaton([r.symbols() for r in rules])
        plain = GlobAutomaton(globs)
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                parts = [host_and_path(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
                canonical = [b"." + h.replace(b"\0", b"\1") + b"\0" + p.replace(b"\0", b"\1") for h, p in parts]
                fits = with_rules.matches(canonical)
                first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if n_rules else np.full(len(parts), -1)
                bad = plain.matches([h + p for h, p in parts]).any(axis=1) if globs else np.zeros(len(parts), dtype=bool)
                made = [
                    pa.array([h.decode("utf-8", "replace") for h, _ in parts], pa.string()),
                    pa.array([p.decode("utf-8", "replace") for _, p in parts], pa.string()),
                    pa.array([rules[i].text if i >= 0 else None for i in first], pa.string()),
                    pa.array([rules[i].action if i >= 0 else "block" if b else "allow" for i, b in zip(first, bad)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *(n for n, _ in names)])

    return inner.mapInArrow(run, schema)
