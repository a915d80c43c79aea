"""License scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates license expressions.

Phrases are matched on whole words of the normalised text (A-Z lower-cased, words of letters, digits and non-ASCII, one
blank between).  Tags (``SPDX-License-Identifier:``) are found by a second automaton in the text as it stands.  The longest well-formed expression that
follows a tag on its line is turned to postfix by a shunting-yard parser (with binds before and, and before or) and evaluated on the stack: an
identifier stands for its terms (``TERMS``, from permissive to unlisted), or takes the milder side (the user may choose), and the stricter one (both bind),
with an exception makes its license one step milder.  Labels are the identifiers of the expression, whatever their number; those
outside ``TERMS`` give the label ``unlisted``.  ``terms`` is the strictest result of all expressions of the text, as several notices bind together.

The score is the chance that at least one find is a license notice, if each kind of find were right with the chance in ``TRUST``, independently:
1 - product of (1 - trust) over the different phrases and expressions.

Defined cases: a null text is an empty text: no words, no labels, score 0, null terms; a tag without a well-formed expression gives the label
``unparsed`` and no terms; repeated rows are answered alike; an empty table gives an empty result; a null doc_id stays null; extra columns are
carried and never read, but for those named like a result, which are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, types as T

from .common import ALNUM, add_columns, texts

#: Base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases that the method adds.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "creative commons": "cc",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
    "spdx license identifier": "spdx",
}
#: Terms from mild to strict, and identifiers without a suffix ``+``, ``-only`` or ``-or-later`` (fixed values).
LEVELS = ("permissive", "weak-copyleft", "copyleft", "restricted", "unlisted")
TERMS = {
    "permissive": "0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc0-1.0 isc mit mit-0 ms-pl ncsa ofl-1.1 openssl pddl-1.0 postgresql psf-2.0 python-2.0 unlicense upl-1.0 w3c wtfpl x11 zlib",
    "weak-copyleft": "artistic-1.0 cddl-1.0 cddl-1.1 cpl-1.0 epl-1.0 epl-2.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 mpl-1.0 mpl-1.1 mpl-2.0 ms-rl",
    "copyleft": "agpl-1.0 agpl-3.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 odbl-1.0 osl-3.0",
    "restricted": "busl-1.1 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 elastic-2.0 sspl-1.0",
}
EXCEPTIONS = frozenset("autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception qt-gpl-exception-1.0 swift-exception wxwindows-exception-3.1".split())
_LEVEL = {name: LEVELS.index(terms) for terms, names in TERMS.items() for name in names.split()}
#: The chance that a find is a license notice: a well-formed expression, a phrase, a phrase of everyday words.
TRUST = {"expression": 0.98, "phrase": 0.8, "loose": 0.4}
LOOSE = {"cc by", "creative commons", "all rights reserved", "spdx license identifier"}
FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")],
    *[T.StructField(n, T.StringType()) for n in ("base_labels", "labels")],
    T.StructField("score", T.DoubleType()),
    T.StructField("terms", T.StringType()),
    T.StructField("expressions", T.ArrayType(T.StringType())),
]

TAG = b"spdx-license-identifier:"
_LOWER = {c: c + 32 for c in range(65, 91)}
_PART = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


def listed(name: str) -> int | None:
    """The level of an identifier's terms; None if it is not in ``TERMS``."""
    return _LEVEL.get(re.sub(r"(\+|-only|-or-later)$", "", name))


def _parts(line: str):
    """Brackets, operators and identifiers at the start of a line, lower-cased, with the place where each ends."""
    at = 0
    while m := _PART.match(line, at):
        part = (m[1] or m[2]).lower()
        cut = part.rstrip(".:-") if m[2] else part  # a full stop behind the expression is none of it
        yield cut, m.end() - len(part) + len(cut)
        if cut != part:
            return
        at = m.end()


def postfix(line: str, whole: bool = True) -> list[str] | None:
    """Shunting-yard: identifiers and operators in postfix order of the longest well-formed expression at the start of the line.

    None if there is none; with ``whole``, also None if anything but blanks follows it.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True  # an operand, not an operator, must come next
    depth = 0
    best, end = None, 0
    for part, at in _parts(line):
        if part == "(":
            if not operand:
                break
            held.append(part)
            depth += 1
        elif part == ")":
            if operand or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif part in _BINDS:
            if operand:
                break
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[part]:
                out.append(held.pop())
            held.append(part)
            operand = True
        else:
            if not operand or not part:
                break
            if held and held[-1] == "with" and out and (out[-1] in _BINDS or out[-1] in EXCEPTIONS):
                break  # an exception is added to one license
            out.append(part)
            operand = False
        if not operand and not depth:
            best, end = (len(out), held[::-1]), at
    if best is None or (whole and line[end:].strip()):
        return None
    return out[: best[0]] + best[1]


def evaluate(parts: list[str]) -> tuple[int, list[str]]:
    """The level of an expression in postfix order, and its identifiers (an exception belongs to its license)."""
    stack: list[tuple[int, str | None]] = []
    names: list[str] = []
    for part in parts:
        if part not in _BINDS:
            level = listed(part)
            stack.append((len(LEVELS) - 1 if level is None else level, part))
            names.append(part)
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if part == "or":
            stack.append((min(a, b), None))
        elif part == "and":
            stack.append((max(a, b), None))
        else:
            names[-2:] = [f"{left} with {right}"]
            stack.append((max(0, a - 1) if right in EXCEPTIONS and a < len(LEVELS) - 1 else a, f"{left} with {right}"))
    return stack[0][0], sorted(set(names))


def automaton() -> ahocorasick.Automaton:
    """Phrases with a blank at either side, so that only whole words match."""
    machine = ahocorasick.Automaton()
    for phrase, label in {**MORE, **BASE}.items():
        machine.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    machine.make_automaton()
    return machine


def tag_automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    machine.add_word(TAG.decode(), len(TAG))
    machine.make_automaton()
    return machine


def tagged(machine, raw: bytes) -> list[str]:
    """The rest of the line behind each tag."""
    flat = raw.decode("latin-1")  # one character a byte, so that places are those of bytes
    found = []
    for end, _ in machine.iter(flat.translate(_LOWER)):
        stop = re.compile(r"[\r\n]|\Z").search(flat, end + 1).start()
        found.append(raw[end + 1 : stop].decode("utf-8", "replace"))
    return found


def scan_text(machine, tags, raw: bytes) -> tuple:
    """One row of FIELDS."""
    parts = raw.translate(ALNUM).split()
    flat = f" {b' '.join(parts).decode('utf-8', 'replace')} "
    base, starts, labels, phrases = set(), [], set(), set()
    for end, (phrase, label, is_base) in machine.iter(flat):
        labels.add(label)
        phrases.add(phrase)
        if is_base:
            base.add(label)
            starts.append(end - len(phrase) - 1)
    doubt = 1.0
    for phrase in phrases:
        doubt *= 1 - TRUST["loose" if phrase in LOOSE else "phrase"]
    expressions, level = [], None
    if "spdx" in labels:
        labels.discard("spdx")
        for line in tagged(tags, raw):
            expression = postfix(line, whole=False)
            if expression is None:
                labels.add("unparsed")
                continue
            expressions.append(" ".join(expression))
            own, names = evaluate(expression)
            labels.update("unlisted" if listed(n.split(" ")[0]) is None else n for n in names)
            level = own if level is None else max(level, own)
    doubt *= (1 - TRUST["expression"]) ** len(set(expressions))
    first, last = (flat.count(" ", 0, f(starts)) if starts else None for f in (min, max))
    terms = None if level is None else LEVELS[level]
    return len(parts), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - doubt, 9), terms, expressions


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the places of base phrases, all labels, a score, the terms and the license expressions in postfix order."""

    def make():
        machine, tags = automaton(), tag_automaton()
        return lambda batch: [list(x) for x in zip(*[scan_text(machine, tags, t) for t in texts(batch, text)])]

    return add_columns(docs, make, FIELDS, text)
