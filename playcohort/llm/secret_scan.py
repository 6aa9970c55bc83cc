"""Secrets in texts: three fixed patterns, and strings that a tokenizer finds hard to encode.

The patterns (assignments of passwords and keys, access key ids, long hexadecimal strings)
are matched leftmost and without overlap per kind; matches below a kind's least length are
dropped after matching.

The further method is a token-efficiency test: words of a language take few tokens for
their characters, random strings many. Runs of at least ``least`` key characters are
candidates when they mix letters and digits, or upper and lower case inside a word; known
digests, UUIDs, numbers, dates, addresses and identifiers made of words are excluded; what
remains is a secret of kind ``random`` where it has fewer than ``ratio`` characters for each
token of the vocabulary. Words of one case and at least ``least`` letters in other runs are
judged by themselves, by the stricter ``one_case_ratio``, as long words and random letters are
nearer to each other. Pattern matches are not reported twice: the parts of a run outside of them
are judged, and letters and digits around a hexadecimal match together with it.

Spans count code points, ends are exclusive. A null text has no spans. Whole texts are
scanned where they are read; nothing is shuffled; equal rows give equal rows, an empty table
an empty table, and columns other than the id and the text are not read (``redact`` passes
them through).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playcohort.llm.common import add_columns, fresh

KINDS = ("assign", "access", "hex", "random")

# The three patterns and their least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
# A run of hexadecimal characters is matched from its first character to its last, so
# asking for the least length at once finds the same matches.
HEX = re.compile(r"[0-9a-f]{16,}")

SPANS = T.ArrayType(
    T.StructType().add("kind", "string").add("start", "long").add("end", "long"), containsNull=False
)

RUN = "[A-Za-z0-9+/_=.-]"
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
NUMERIC = re.compile(r"[0-9.+/_=-]+([eE][0-9+-]+)?")
DATE = re.compile(r"[0-9]{4}[-/.]?[0-9]{2}[-/.]?[0-9]{2}[T_.-]?[0-9.+-]*Z?")
# Words in lower, upper or title case, camel case included, with short numbers between
# separators: names of variables, files, hosts and paths.
SEPARATORS = re.compile(r"[._/=+-]+")
FIRST_PART = re.compile(r"[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}")
PART = re.compile(r"[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}")
# Letters of one case, that may begin with a capital.
ONE_CASE = re.compile(r"(?<![A-Za-z0-9])([A-Z]?[a-z]+|[A-Z]+)(?![A-Za-z0-9])")
ALNUM = re.compile(r"[A-Za-z0-9]*")
WORDY = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every pattern match, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def identifier(run: str) -> bool:
    """Whether all parts between separators are words or short numbers."""
    parts = [part for part in SEPARATORS.split(run) if part]
    return bool(parts and FIRST_PART.fullmatch(parts[0])) and all(map(PART.fullmatch, parts[1:]))


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and identifiers made of words."""
    if NUMERIC.fullmatch(run) or DATE.fullmatch(run) or UUID.fullmatch(run):
        return True
    if len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run):
        return True
    # Camel case is an identifier only where its words have some length on average.
    if identifier(run):
        words = WORDY.findall(run)
        letters = sum(c.isalpha() for c in run)
        changes = sum(a.islower() != b.islower() for a, b in zip(run, run[1:]) if a.isalpha() and b.isalpha())
        return sum(map(len, words)) >= 0.8 * letters and changes <= letters / 3
    return False


def scanner(
    vocabulary_file: str, pattern: str, ratio: float, least: int, one_case_ratio: float = 2.0
) -> Callable[[list], list]:
    """A function from texts (or None) to their spans, each sorted by start and kind."""
    runs = re.compile(f"(?<!{RUN}){RUN}{{{least},}}")
    state: dict = {}

    def tokens(run: str) -> int:
        if not state:
            import base64

            import tiktoken

            with open(vocabulary_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            state["encoding"] = tiktoken.Encoding(
                "vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )
        return len(state["encoding"].encode_ordinary(run))

    def is_random(run: str) -> bool:
        mixed = any(c.isdigit() for c in run) or any(c.isupper() for c in run[1:]) and any(c.islower() for c in run)
        return mixed and any(c.isalpha() for c in run) and not known(run) and len(run) < ratio * tokens(run)

    def judged(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """The spans of a run, or of a part of one."""
        run = text[start:end].rstrip(".")
        if len(run) < least:
            return []
        if is_random(run):
            return [(start, 3, start + len(run))]
        words = (m for m in ONE_CASE.finditer(run) if m.end() - m.start() >= least)
        return [(start + m.start(), 3, start + m.end()) for m in words if len(m.group()) < one_case_ratio * tokens(m.group())]

    def random_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        # Base spans in order of their starts, as disjoint ones; whether hexadecimal only.
        disjoint: list[tuple[int, int, bool]] = []
        for s, kind, e in base:
            if disjoint and s < disjoint[-1][1]:
                disjoint[-1] = (disjoint[-1][0], max(e, disjoint[-1][1]), disjoint[-1][2] and kind == 2)
            else:
                disjoint.append((s, e, kind == 2))
        first = 0
        for match in runs.finditer(text):
            start, end = match.span()
            while first < len(disjoint) and disjoint[first][1] <= start:
                first += 1
            touched, i = [], first
            while i < len(disjoint) and disjoint[i][0] < end:
                touched.append(disjoint[i])
                i += 1
            # The parts of the run outside of base spans.
            at = start
            for s, e, _ in [*touched, (end, end, False)]:
                out += judged(text, at, s)
                at = max(at, e)
            # A key with hexadecimal characters inside: what is left of it on both sides. Each
            # key is looked at once, whatever number of spans it has.
            done = start
            for i, (s, e, hexadecimal) in enumerate(touched):
                if e <= done or not hexadecimal:
                    done = max(done, e)
                    continue
                left, right, inner = s, ALNUM.match(text, e, end).end(), []
                while left > done and text[left - 1].isalnum():
                    left -= 1
                for t, u, same in touched[i : i + right - e + 1]:
                    if t >= right or not same:
                        right = min(right, t) if t > e else right
                        break
                    inner.append((t, u))
                done = right
                if is_random(text[left:right]):
                    at = left
                    for t, u in [*inner, (right, right)]:
                        if t > at and text[at:t] not in ("0x", "0X"):
                            out.append((at, 3, t))
                        at = max(at, u)
        return sorted(set(out))

    def scan(texts: list) -> list:
        found = []
        for text in texts:
            base = base_spans(text) if text else []
            found.append(sorted(base + random_spans(text, base)) if text else [])
        return found

    return scan


def find_secrets(
    docs: DataFrame,
    vocabulary_file: str,
    pattern: str,
    text_col: str = "text",
    ratio: float = 2.2,
    least: int = 16,
    name: str = "spans",
) -> DataFrame:
    """``docs`` with ``name``: an array of (kind, start, end), sorted by start and kind order.

    ``vocabulary_file`` has the ranks of a byte-level vocabulary, ``pattern`` cuts its words.
    """
    scan = scanner(vocabulary_file, pattern, ratio, least)

    def spans(texts: list) -> dict[str, list]:
        return {
            name: [
                [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in found]
                for found in scan(texts)
            ]
        }

    return add_columns(docs, [text_col], spans, T.StructType().add(name, SPANS))


def redact(
    docs: DataFrame,
    vocabulary_file: str,
    pattern: str,
    text_col: str = "text",
    length_col: str | None = None,
    mask: str = "[SECRET]",
    ratio: float = 2.2,
    least: int = 16,
) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; other columns stay.

    Overlapping spans are masked as one. ``length_col`` is set to the new length in code
    points where a text changes. Null texts stay null.
    """
    scan = scanner(vocabulary_file, pattern, ratio, least)
    clean = fresh(docs, "_clean")

    def masked(texts: list) -> dict[str, list]:
        out = []
        for text, found in zip(texts, scan(texts)):
            if found:
                parts, at = [], 0
                for start, _, end in found:
                    if start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return {clean: out}

    done = add_columns(docs, [text_col], masked, T.StructType().add(clean, "string"))
    changed = ~F.col(clean).eqNullSafe(F.col(text_col))
    kept = []
    for c in docs.columns:
        if c == text_col:
            kept.append(F.col(clean).alias(c))
        elif c == length_col:
            kept.append(F.when(changed, F.length(clean).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            kept.append(F.col(c))
    return done.select(*kept)
