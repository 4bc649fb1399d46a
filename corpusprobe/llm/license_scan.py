"""License scan by an exact set-similarity join with templates.

A block is any run of consecutive words of a text, whatever its line breaks.
A block no longer than a template T (its words in sequence) plus ``SLACK`` words
matches T when it holds at least ``need = ceil(CONTAINMENT * |T|)`` of T's
distinct words. First the distinct words of the whole text meet the templates;
where those match, all its blocks are counted exactly. The words of all
templates are ordered by the number of texts of the whole corpus that hold
them, rarest first. Then

* prefix filter: a matching text holds one of T's ``|T| - need + 1`` rarest words;
* length filter: it holds at least ``need`` template words at all;
* positional filter: at the first common word, place i of T and j of the
  text's template words, ``1 + min(|T| - i - 1, rest of the text's)`` is at least ``need``;

and what passes is counted, over the text and then over its blocks. Templates
are a fixed short list, so they travel with the tasks; the corpus is read twice
and never shuffled.

Besides, ``BASE_PHRASES`` are looked for word by word, across lines as well.

Defined results: null and empty texts have no words and no labels; repeated
rows are reported each; an empty table gives an empty result; extra columns of
the input don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, text_bytes

CONTAINMENT = 0.9
#: Words that a block may have besides the template's (comment signs spelled as words, insertions).
SLACK = 4

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label and wording of each template.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def template_sets() -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(alnum_words(text.encode()))) for label, text in TEMPLATES]


def needed(size: int) -> int:
    """Least number of common words; CONTAINMENT in whole per cent."""
    return -(-size * round(CONTAINMENT * 100) // 100)


def text_counts(docs: DataFrame) -> dict[bytes, int]:
    """Texts of the corpus that hold each template word (a few dozen words)."""
    vocabulary = frozenset().union(*(words for _, words in template_sets()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for raw in text_bytes(batch):
                seen.update(vocabulary.intersection(alnum_words(raw)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class TemplateJoin:
    """The templates ordered by global frequency, ready to meet texts."""

    def __init__(self, counts: dict[bytes, int]):
        sets = template_sets()
        vocabulary = sorted(frozenset().union(*(w for _, w in sets)), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: r for r, w in enumerate(vocabulary)}
        self.vocabulary = frozenset(vocabulary)
        self.labels = [label for label, _ in sets]
        self.sorted = [sorted(self.rank[w] for w in words) for _, words in sets]
        self.needs = [needed(len(words)) for _, words in sets]
        #: most words of a block
        self.spans = [len(alnum_words(text.encode())) + SLACK for _, text in TEMPLATES]
        #: rank of a prefix word -> (template, place in it)
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, ranks in enumerate(self.sorted):
            for place, r in enumerate(ranks[:len(ranks) - self.needs[t] + 1]):
                self.prefixes.setdefault(r, []).append((t, place))

    def held(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Every template that the distinct words match, and the number of common words."""
        block = sorted(self.rank[w] for w in self.vocabulary.intersection(words))
        seen, out = set(), []
        for j, r in enumerate(block):
            for t, i in self.prefixes.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # a template's first common word decides
                need, size = self.needs[t], len(self.sorted[t])
                if len(block) < need or 1 + min(size - i - 1, len(block) - j - 1) < need:
                    continue
                both = len(set(block).intersection(self.sorted[t]))
                if both >= need:
                    out.append((t, both))
        return out

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Label and containment of every template that one block, long or short, matches."""
        return [(self.labels[t], both / len(self.sorted[t])) for t, both in self.held(words)]

    def block_matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Label and largest containment of every template that some block of a text matches."""
        out = []
        for t, _ in self.held(words):
            own, inside = set(self.sorted[t]), Counter()
            places = [(i, r) for i, w in enumerate(words) if (r := self.rank.get(w)) in own]
            best = start = 0
            for i, r in places:
                inside[r] += 1
                while places[start][0] <= i - self.spans[t]:
                    gone = places[start][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    start += 1
                best = max(best, len(inside))
            if best >= self.needs[t]:
                out.append((self.labels[t], best / len(own)))
        return out


def phrase_places(words: list[bytes]) -> dict[str, list[int]]:
    """Word numbers at which each base phrase starts."""
    line = b" " + b" ".join(words) + b" "
    found = {}
    for phrase in BASE_PHRASES:
        wanted, at, places = b" " + phrase.encode() + b" ", -1, []
        while (at := line.find(wanted, at + 1)) >= 0:
            places.append(line.count(b" ", 0, at))
        if places:
            found[phrase] = places
    return found


_SCAN = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
         "base_labels string, labels string, score double")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document, see ``_SCAN``. ``score`` is 1 with a base phrase,
    else the largest containment of a matching template, else 0."""
    joined = TemplateJoin(text_counts(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                words = alnum_words(raw)
                base = phrase_places(words)
                places = sorted(p for at in base.values() for p in at)
                own = {BASE_PHRASES[p] for p in base}
                met = joined.block_matches(words)
                rows.append((doc_id, len(words), len(places), places[0] if places else None, places[-1] if places else None,
                             ",".join(sorted(own)), ",".join(sorted(own.union(label for label, _ in met))),
                             1.0 if own else max((c for _, c in met), default=0.0)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=[c.split()[0] for c in _SCAN.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, _SCAN)
