"""Labelled spans for training the tagger of ``pii``, made by rule from this project's texts.

The rules know how the invented names, streets and towns are put together; they are used
to label training and test texts only, and no query runs them.
"""

from __future__ import annotations

import re

from loomgraph.llm.pii import EMAIL, IDNUM, PHONE

# Parts of the invented names and places, and titles.
ROOTS = "Brann|Dray|Fen|Hol|Kast|Lind|Mos|Nør|Nor|Orr|Pell|Quell|Rusk|Sarn|Tes|Thav|Ulm|Var|Wex|Yarr|Zel"
MIDDLES = "and|an|ar|el|eth|ick|inn|in|ist|mond|ov|ow|un"
ENDS = ["by", "dane", "gård", "holt", "ley", "mar", "ova", "quist", "sen", "tin", "wick"]
SURNAME = f"(?:{ROOTS})(?:{MIDDLES})(?:by|dane|gård|gard|holt|ley|mar|ova|quist|sen|tin|wick)"
TOWN = f"(?:{ROOTS})(?:{MIDDLES})(?:burgh|by|feld|ford|ham|mouth|stead)"
STREET = f"(?:{ROOTS})(?:{MIDDLES})(?:brook|croft|field|gate|moor|vale)"
TITLE = r"(?:Dr|Prof|Mr|Ms|Mrs|Herr|Frau)\.?"

SEP = r"(?:\s*,\s*|\s+)"
ADDRESS = re.compile(
    rf"(?:\d{{1,3}}[a-z]?\s+{STREET}\s+(?:Road|Lane|Close|Avenue|Ave\.|Street|St\.|Rd\.)(?:{SEP}Flat\s+\d+)?(?:{SEP}{TOWN}(?:\s+\d{{5}})?)?"
    rf"|Calle\s+{STREET}\s+\d+(?:{SEP}\d+º\s+[A-Z])?(?:{SEP}{TOWN})?"
    rf"|{STREET}(?:straße|strasse|\s+Weg)\s+\d+(?:{SEP}\d{{5}}\s+{TOWN})?"
    rf"|\d+\s+rue\s+de\s+{STREET}(?:{SEP}\d{{5}}\s+{TOWN})?"
    rf"|P\.?\s?O\.?\s+Box\s+\d+(?:{SEP}{TOWN}(?:\s+\d{{5}})?)?)",
    re.I,
)
INITIAL = r"[A-ZÀ-Þ]\."
NOT_GIVEN = {"yesterday", "by", "to", "with", "is", "of", "and", "thanks", "at", "for", "from", "the", "ask"}
GIVEN = rf"(?!(?:{'|'.join(sorted(NOT_GIVEN))})\b)[^\W\d_]{{3,}}"
PERSON = re.compile(rf"(?<![\w@])(?:(?:{GIVEN}\s+(?:{INITIAL}\s+)?|{INITIAL}\s+)(?:{SURNAME})|{SURNAME},\s+(?:{GIVEN}|{INITIAL}))(?!\w)", re.I)
KINDS = ("person", "email", "phone", "idnum", "address")


def labelled(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each place, in order, none overlapping."""
    taken = [False] * len(text)
    out = []
    for kind, rule in (("email", EMAIL), ("address", ADDRESS), ("idnum", IDNUM), ("phone", PHONE), ("person", PERSON)):
        for m in rule.finditer(text):
            a, b = m.span()
            if kind == "email" and re.search(r"@latest$|@[\d.]+$", m.group()):
                continue
            if kind == "person":
                t = re.match(rf"{TITLE}\s+", text[a:b], re.I)
                a += t.end() if t else 0
                if re.match(rf"(?:{STREET}|box|weg|rue|calle)\b", text[a:b], re.I):
                    continue
            if not any(taken[a:b]):
                out.append((kind, a, b))
                taken[a:b] = [True] * (b - a)
    return sorted(out, key=lambda x: x[1])
