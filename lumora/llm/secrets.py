"""Secret scans: a recursive decoding worklist over whole texts.

Every text is scanned for three kinds of secrets (see ``RULES``). Then nested layers are unwrapped: the text with
its URL escapes decoded where they stand, with its Unicode and character escapes decoded, and what each base64 run
or block of wrapped lines holds, after a path or prefix and between binary bytes too, and in compressed form. Each decoded layer goes on a worklist, is scanned by the same rules, and is unwrapped
in turn until no new layer turns up. A layer knows the places in the original that each of its characters came from (of a
base64 run, one range: the whole run), and what is found in it is reported with those. Cycle detection is by a layer's
content and places, so no layer is visited twice. The worklist holds one open layer for each depth, not all layers.

Escapes within escapes are unwrapped layer by layer up to LEVELS deep, and from there on to their fixpoint in one pass over
the text, so that the work stays linear however deep they are; no escape holds a character that a secret can have, so a
secret of a layer in between is still there at the fixpoint. Compressed layers are read in pieces of PIECE bytes, all
members of a stream, and never held whole.

Null texts count as empty and yield no spans. Rows are independent of each other: repeated rows and ids
give repeated results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .jobs import prepare, table, tidy
from .text import column, slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")  # a greedy run; shorter ones are dropped anyway
#: Kind, the pattern, and the least length of the group that counts.
RULES = (("assign", _ASSIGN, 2, 12), ("access", _ACCESS, 0, 18), ("hex", _HEX, 0, 16))
_WORDS = re.compile("pass(?:word|wd)|secret|token|api_?key")

_URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: A run that goes on in the next lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t>]*")
#: What can hold a secret or a further layer: both are ASCII, and no secret is shorter.
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")

#: Compressed layers are scanned in pieces of this size; a piece ends before the run that is open at its end (up to CARRY), and
#: OVERLAP bytes before that belong to the next one as well.
PIECE, OVERLAP, CARRY = 1 << 20, 4096, 4 << 20
LEVELS = 6
_OPEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\&#;{}\r\n"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) in code points, in order."""
    out = []
    for k, (_, pattern, group, least) in enumerate(RULES):
        if k == 0 and not _WORDS.search(text.lower()) or k == 1 and "AKIA" not in text:
            continue
        out += [(m.start(), m.end(), k) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _unescape(m: re.Match) -> list[tuple[str, int, int]]:
    """The characters of an escape with the places that each comes from."""
    if m.lastindex is None:  # a pair of surrogates
        high, low = int(m[0][2:6], 16), int(m[0][8:12], 16)
        code = 0x10000 + ((high - 0xD800) << 10) + low - 0xDC00
    else:
        code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5] or m[6], 16)
    return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", m.start(), m.end())]


def _unquote(m: re.Match) -> list[tuple[str, int, int]]:
    raw = bytes.fromhex(m[0].replace("%", ""))
    out, at = [], m.start()
    try:
        for c in raw.decode("utf-8"):
            n = 3 * len(c.encode())
            out.append((c, at, at + n))
            at += n
    except UnicodeDecodeError:  # each byte on its own
        return [(chr(b), m.start() + 3 * i, m.start() + 3 * i + 3) for i, b in enumerate(raw)]
    return out


#: Places in the original of a layer's characters: arrays of where each begins and ends, or one range for all; none for the original itself.
Places = tuple[np.ndarray, np.ndarray] | tuple[int, int] | None


def _span(places: Places, start: int, end: int) -> tuple[int, int]:
    """Where a part of a layer is in the original."""
    if places is None:
        return start, end
    if isinstance(places[0], int):
        return places
    return int(places[0][start]), int(places[1][end - 1])


def _through(places: Places, lo: np.ndarray, hi: np.ndarray) -> Places:
    if places is None:
        return lo, hi
    return places if isinstance(places[0], int) else (places[0][lo], places[1][hi - 1])


def _in_place(text: str, places: Places, pattern: re.Pattern, decode) -> tuple[str, Places]:
    """A text with all matches decoded where they stand."""
    exact = places is None or not isinstance(places[0], int)
    parts, begins, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        got = decode(m)
        parts += [text[at : m.start()], "".join(c for c, _, _ in got)]
        if exact:
            plain = np.arange(at, m.start())
            begins += [plain, np.array([a for _, a, _ in got], dtype=np.int64)]
            ends += [plain + 1, np.array([b for _, _, b in got], dtype=np.int64)]
        at = m.end()
    whole = "".join(parts) + text[at:]
    if not exact:
        return whole, places
    rest = np.arange(at, len(text))
    return whole, _through(places, np.concatenate([*begins, rest]), np.concatenate([*ends, rest + 1]))


#: An escape that ends with the last character of a text.
_TAIL = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8}))\Z")
_ENDS = frozenset("0123456789abcdefABCDEF;}")


def _reduce(text: str, places: Places) -> tuple[str, Places]:
    """A text with all escapes of ASCII characters decoded again and again until none is left, in one pass."""
    out: list[str] = []
    lo, hi = array("q"), array("q")
    for i, c in enumerate(text):
        out.append(c)
        lo.append(i)
        hi.append(i + 1)
        while out[-1] in _ENDS:
            tail = "".join(out[-12:])
            m = _TAIL.search(tail) if "%" in tail or "\\" in tail or "&" in tail else None
            code = (int(m[5]) if m[5] else int(m[m.lastindex], 16)) if m else 0x80
            if code >= 0x80:
                break
            n, end = m.end() - m.start(), hi[-1]
            del out[-n + 1 :], lo[-n + 1 :], hi[-n + 1 :]
            out[-1], hi[-1] = chr(code), end
    return "".join(out), _through(places, np.frombuffer(lo, dtype=np.int64), np.frombuffer(hi, dtype=np.int64)) if out else ("", places)


def _box(raw: bytes):
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 1 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflate(raw: bytes) -> Iterator[str]:
    """The texts of a compressed layer, of all its members, piece by piece."""
    held = b""
    while (box := _box(raw)) is not None:
        rest, raw = raw, b""
        try:
            while True:
                got = box.decompress(rest, PIECE)
                rest = box.unconsumed_tail if hasattr(box, "unconsumed_tail") else b""
                held += got
                if len(held) >= PIECE:
                    closed = len(held.rstrip(_OPEN))
                    if not closed and len(held) > CARRY:
                        closed = len(held)
                    if closed:
                        yield held[:closed].decode("utf-8", "replace")
                        held = held[max(0, closed - OVERLAP) :] if closed < len(held) or len(held) <= CARRY else held[-OVERLAP:]
                if box.eof:
                    raw = box.unused_data.lstrip(b"\x00")
                    break
                if not got or not rest and len(got) < PIECE and getattr(box, "needs_input", True):
                    break
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
    if held:
        yield held.decode("utf-8", "replace")


def _bytes(s: str) -> bytes:
    """What base64 digits give; one that is left over at the end is dropped."""
    s = s[:-1] if len(s) % 4 == 1 else s
    return binascii.a2b_base64(s + "=" * (-len(s) % 4))


def _packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0 or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00"


def _b64(s: str) -> Iterator[str]:
    s = s.rstrip("=")
    starts = {0, 1, 2, 3} | {m.end() for m in re.finditer("[/_-]", s)}  # a run can begin with what belongs to a path or a name before it
    s = s.replace("-", "+").replace("_", "/")
    for at in sorted(starts):
        if len(s) - at >= 8 and _packed(_bytes(s[at : at + 8])):
            yield from _inflate(_bytes(s[at:]))
    for cut in range(4):  # any other beginning is in step with one of these
        raw = _bytes(s[cut:])
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = ""
        if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text):
            yield text
        else:
            yield from (m[0].decode() for m in _STRETCH.finditer(raw))


def layers(text: str, places: Places = None, level: int = 0) -> Iterator[tuple[str, Places, int]]:
    """What a text can be unwrapped to, with how many escapes deep it is: itself with its URL or Unicode escapes decoded, and what each base64 run holds."""
    url, code = "%" in text and _URL.search(text), ("\\" in text or "&#" in text) and _ESCAPE.search(text)
    if level < LEVELS:
        if url:
            yield *_in_place(text, places, _URL, _unquote), level + 1
        if code:
            yield *_in_place(text, places, _ESCAPE, _unescape), level + 1
    elif level == LEVELS and (url or code):
        inner, where = _reduce(text, places)
        yield inner, where, LEVELS + 1
    elif level == LEVELS + 1 and (url or code):  # escapes of other characters than ASCII are left
        inner, where = _in_place(text, places, _URL, _unquote)
        yield *_in_place(inner, where, _ESCAPE, _unescape), LEVELS + 2
    for m in (*_BASE64.finditer(text), *_WRAPPED.finditer(text)):
        where = _span(places, m.start(), m.end())
        for got in _b64(_BREAK.sub("", m[0])):
            if got:
                yield got, where, 0


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The spans found in the text as it is, and all spans with those of decoded layers, in the original's code points."""
    base = scan(text)
    spans, seen, work = set(base), set(), [layers(text)]
    while work:
        got = next(work[-1], None)
        if got is None:
            work.pop()
            continue
        inner, places, level = got
        mark = hashlib.blake2b(inner.encode("utf-8", "replace"), digest_size=16)
        mark.update(repr(places).encode() if isinstance(places[0], int) else places[0].tobytes() + places[1].tobytes())
        key = (mark.digest(), level > LEVELS)
        if key in seen or inner == text:
            continue
        seen.add(key)
        spans.update((*_span(places, s, e), k) for s, e, k in scan(inner))
        work.append(layers(inner, places, level))
        del got, inner, places
    return base, sorted(spans, key=lambda s: (s[0], s[2], s[1]))


#: Bytes that may stand in a base64 or a hex run.
_RUN64 = np.zeros(256, dtype=bool)
_RUN64[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 45, 95]] = True
_RUN16 = np.zeros(256, dtype=bool)
_RUN16[[*range(48, 58), *range(97, 103)]] = True


def _long_runs(raw: np.ndarray, off: np.ndarray, table_: np.ndarray, least: int) -> np.ndarray:
    """Per row, whether it has a run of at least so many bytes of the table."""
    edge = np.flatnonzero(~table_[raw])
    cuts = np.concatenate(([-1], edge, [len(raw)]))
    starts, ends = cuts[:-1] + 1, cuts[1:]
    keep = ends - starts >= least
    out = np.zeros(len(off) - 1, dtype=bool)
    for lo, hi in zip(starts[keep], ends[keep], strict=True):  # runs that touch several rows flag each; the scan itself decides
        a, b = np.searchsorted(off, lo, side="right") - 1, np.searchsorted(off, hi, side="left")
        out[a:b] = True
    return out


def suspects(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row of a slice, whether anything in it can match a rule or be unwrapped (no row that can is left out)."""
    flags = _long_runs(raw, off, _RUN64, 20) | _long_runs(raw, off, _RUN16, 16)
    low = raw.tobytes().lower()
    for word in (b"passw", b"secret", b"token", b"api_key", b"apikey", b"akia", b"\\u", b"\\x", b"&#"):
        at = low.find(word)
        while at >= 0:
            row = int(np.searchsorted(off, at, side="right")) - 1
            flags[row] = True
            at = low.find(word, int(off[row + 1]))
    if b"%" in low:
        at = np.flatnonzero(raw[:-2] == 37) if len(raw) > 2 else np.zeros(0, dtype=np.int64)
        hexa = _RUN16 | _RUN16[np.arange(256) | 32] & (np.arange(256) >= 65)
        at = at[hexa[raw[at + 1]] & hexa[raw[at + 2]]]
        flags[np.searchsorted(off, at, side="right") - 1] = True
    return flags


_OUT = pa.schema([("doc_id", pa.int64()), ("kind", pa.list_(pa.string())), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())), ("base", pa.list_(pa.bool_()))])


@tidy
def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = column(batch, "text"), column(batch, "doc_id")
        kinds, starts, ends, bases = [], [], [], []
        for lo, hi, raw, off in slices(texts):
            flags = suspects(raw, off)
            for row in range(lo, hi):
                base, spans = find(texts[row].as_py() or "") if flags[row - lo] else ([], [])
                have = set(base)
                kinds.append([KINDS[k] for _, _, k in spans])
                starts.append([s for s, _, _ in spans])
                ends.append([e for _, e, _ in spans])
                bases.append([s in have for s in spans])
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(bases, pa.list_(pa.bool_()))], schema=_OUT)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and its spans as parallel arrays kind, start, end, base (found without unwrapping), in order of start, kind, end."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, "doc_id long, kind array<string>, start array<long>, end array<long>, base array<boolean>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each text's secrets, merged where they overlap, replaced by ``[REDACTED:kind]``; other columns stay.

    A text without secrets, and a null text, stay as they are; n_chars, if there, follows the new text.
    """
    prepare(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, new = column(batch, "text"), {}
            for lo, hi, raw, off in slices(texts):
                for row in (lo + np.flatnonzero(suspects(raw, off))).tolist():
                    text = texts[row].as_py() or ""
                    out, at, merged = [], 0, []
                    for s, e, k in sorted(find(text)[1]):
                        if merged and s < merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e, k])
                    for s, e, k in merged:
                        out += [text[at:s], f"[REDACTED:{KINDS[k]}]"]
                        at = e
                    if merged:
                        new[row] = "".join(out) + text[at:]
            if new:
                have = texts.to_pylist()
                for row, text in new.items():
                    have[row] = text
                columns = list(batch.columns)
                columns[names.index("text")] = pa.array(have, texts.type)
                if "n_chars" in names:
                    n = column(batch, "n_chars").to_pylist()
                    for row, text in new.items():
                        n[row] = len(text)
                    columns[names.index("n_chars")] = pa.array(n, column(batch, "n_chars").type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, schema)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents, digested."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, kind, start, end, base in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                marks = [f"{k}:{s}:{e}" for k, s, e in zip(kind, start, end, strict=True)]
                own = [(k, m) for k, m, b in zip(kind, marks, base, strict=True) if b]
                rows.append((doc, *(sum(k == x for k, _ in own) for x in KINDS), hashlib.sha256(",".join(m for _, m in own).encode()).hexdigest(), ",".join(marks)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _DIGEST, strict=True)], schema=_DIGEST)

    return secret_spans(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE: dict[str, str] = {}
