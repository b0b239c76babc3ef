"""Subject areas of documents by class-association rules.

Sentences of hand-labelled documents become transactions: their content words, stripped of frequent endings, and the
labels of their document. Words that stand with some subject clearly more often than chance, counted by documents, are
kept. Rules {words} -> subject are mined by parallel frequent-pattern growth: every transaction is cut into the prefixes
that its words have in the order of frequency, the prefixes of a word make a shard, and each shard grows its patterns on
its own, up to `longest` words; equal prefixes are merged before they are shuffled. The confidence of a rule is calibrated
by shrinking it towards the share of its subject. A rule is redundant if a rule on part of its words is as sure. A
sentence deals with a subject if the best rule it matches is at least `sure`; a document has the subjects that at least
`share` of its sentences deal with. Greetings, headings and closing lines are no sentences.

How pure a word of one subject can be expected to be, given wrong labels and passing mentions, is measured on the labels:
it is a part (SLACK) of the purity of the typical word that mostly stands with one subject.

Bounds: rules are mined on at most LABELLED documents (in hash order, a bound on the classifier's sample), which bounds
shards and rules; all documents are scored whole.

Cases: labels are trimmed and lower-cased, unknown and null ones ignored, 'none' counts as no subject; null and empty
texts have no sentences and no subjects; repeated labels count once; several rows of a doc_id are scored each, the
result being distinct; without labels there are no rules and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpmill.llm.text import WORD
from kelpmill.session import written

LABELLED = 50_000
SLACK = 0.95  # of the purity of the typical word of one subject
LEADS = re.compile(r"^(?:[\s>|]*)(?:[-*•#]+\s+)?(?:\[\d{1,2}:\d{2}(?::\d{2})?\]\s*)?(?:speaker \d+\s*:|[a-z]{3,14}:(?=\s))?\s*", re.IGNORECASE)
BULLET = re.compile(r"^[\s>|]*(?:[-*•]\s|\[\d{1,2}:\d{2})")
RULE_LINE = re.compile(r"^[\s>|]*(?:[=\-_~*]{3,}|#{1,6}\s.*)$")
END = re.compile(r"(?<=[.!?。])[\"'”’)]*\s+")
#: Endings of Korean nouns.
PARTICLES = re.compile(r"(?:에서|까지|부터|으로|을|를|이|가|은|는|과|와|의|에|로|도|만)$")


def sentences(text: str | None) -> list[str]:
    """Sentences without greetings, headings and speakers in front."""
    blocks: list[str] = []
    fresh = True
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for k, line in enumerate(lines):
        bare = line.strip(" \t>|")
        if not bare or RULE_LINE.match(line):
            fresh = True
            continue
        if k + 1 < len(lines) and re.match(r"^\s*(={3,}|-{3,})\s*$", lines[k + 1]):  # an underlined heading
            fresh = True
            continue
        body = LEADS.sub("", line, count=1).strip()
        if not body:
            continue
        if fresh or BULLET.match(line):
            blocks.append(body)
        else:
            blocks[-1] += " " + body
        fresh = False
    out = []
    for block in blocks:
        for s in END.split(block):
            s = s.strip()
            if len(WORD.findall(s)) >= 2 and s.rstrip("\"'”’) 🙂👍")[-1:] in ".!?。…;":
                out.append(s)
            elif len(WORD.findall(s)) >= 7 and not s.isupper() and s[-1:] not in ",:":
                out.append(s)
    return out


def items(sentence: str) -> list[str]:
    """Distinct content words of a sentence, Korean ones without their particle."""
    out = set()
    for w in WORD.findall(sentence.lower()):
        if "가" <= w[-1] <= "힣":
            if len(w) >= 3:
                w = PARTICLES.sub("", w) or w
            out.add(w)
        elif len(w) >= 3 and not w.isdigit():
            out.add(w)
    return sorted(out)


def _sentences(batches):
    for b in batches:
        docs, numbers, words = [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for k, s in enumerate(sentences(text)):
                docs.append(doc)
                numbers.append(k)
                words.append(items(s))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "sentence", "items"])


def labelled(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, labels): clean labels of each labelled document, '=none' for none."""
    known = areas.select(F.lower(F.trim("subject")).alias("subject")).distinct()
    clean = labels.select("doc_id", F.lower(F.trim("subject_label")).alias("subject")).filter("doc_id IS NOT NULL AND subject IS NOT NULL")
    kept = clean.join(known, "subject", "left_semi").unionByName(clean.filter("subject = 'none'"))
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("="), "subject"))).alias("labels"))


def grow(base: list[tuple[list[str], tuple[str, ...], int]], found: tuple[str, ...], least: int, longest: int, out: list) -> None:
    """Patterns that end in `found`, from the prefixes that stand before it: (words, label or '', count), '' for all."""
    total, labels = 0, Counter()
    for _, heads, n in base:
        total += n
        for h in heads:
            labels[h] += n
    if len(found) > 1:
        words = sorted(found)
        out.append((words, "", total))
        out += [(words, h, n) for h, n in labels.items() if n >= least]
    if len(found) == longest:
        return
    often: Counter = Counter()
    for prefix, _, n in base:
        for w in prefix:
            often[w] += n
    for w, n in often.items():
        if n >= least:
            grow([(p[: p.index(w)], h, k) for p, h, k in base if w in p], (*found, w), least, longest, out)


def _shard(least: int, longest: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = [(list(p), tuple(h), int(n)) for p, h, n in zip(pdf["prefix"], pdf["labels"], pdf["n"])]
        out: list = []
        if sum(n for *_, n in base) >= least:
            grow(base, (pdf["word"].iloc[0],), least, longest, out)
        return pd.DataFrame(out, columns=["words", "label", "n"])

    return run


def patterns(transactions: DataFrame, least: int, longest: int) -> DataFrame:
    """(words, label, n): sets of 2 to `longest` words that stand together in at least `least` transactions, and in how many
    of them with each label; label '' for all. transactions: words in order of frequency, labels."""
    ends = transactions.select("words", "labels", F.posexplode("words").alias("at", "word"))
    prefixes = ends.select("word", F.slice("words", F.lit(1), F.col("at")).alias("prefix"), "labels")
    merged = prefixes.groupBy("word", "prefix", "labels").agg(F.count(F.lit(1)).alias("n"))
    return merged.groupBy("word").applyInPandas(_shard(least, longest), "words array<string>, label string, n long")


def rules(docs: DataFrame, labels: DataFrame, areas: DataFrame, least_docs: int = 3, prior: float = 2.0, hint: float = 0.3, sure: float = 0.6, longest: int = 3) -> DataFrame:
    """(words: sorted array, subject, confidence, support)."""
    given = labelled(labels, areas).orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    rows = docs.join(given, "doc_id").filter("text IS NOT NULL")
    said, _ = written(rows.select("doc_id", "text").mapInArrow(_sentences, "doc_id long, sentence int, items array<string>").join(given, "doc_id"), "labelled")
    n_docs = given.count()
    if not n_docs:
        return docs.sparkSession.createDataFrame([], "words array<string>, subject string, confidence double, support long")
    base = given.select("doc_id", F.explode("labels").alias("label")).groupBy("label").agg((F.count(F.lit(1)) / n_docs).alias("base"))
    word_docs = said.select("doc_id", "labels", F.explode("items").alias("word")).distinct()
    of_word = word_docs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs)
    of_pair = word_docs.select("word", F.explode("labels").alias("label")).groupBy("word", "label").agg(F.count(F.lit(1)).alias("n_label"))
    calibrated = (F.col("n_label") + F.lit(prior) * F.col("base")) / (F.col("n") + F.lit(prior))
    single = of_word.join(of_pair, "word").join(base, "label").withColumn("confidence", calibrated).filter("label <> '=none'")
    single, _ = written(single.select("word", "label", "confidence", "n", "n_label", "base"), "words")
    typical = single.filter(F.col("n_label") > 0.5 * F.col("n")).agg(F.expr("percentile(n_label / n, 0.5, n)")).first()[0]  # one number
    expected = SLACK * (typical or 1.0)
    # no rule whose confidence, given its support, can't be that of words of one subject
    pure = F.col("n_label") / F.col("n") + 1.3 * F.sqrt(F.lit(0.1) / F.col("n")) >= expected
    telling = single.filter((F.col("confidence") >= hint) & (F.col("confidence") >= 2 * F.col("base"))).groupBy("word").agg(F.max("n").alias("n"))
    kept = said.select("doc_id", "sentence", "labels", F.explode("items").alias("word")).join(telling, "word")
    ranked = F.transform(F.array_sort(F.collect_set(F.struct((-F.col("n")).alias("n"), "word"))), lambda w: w["word"])
    transactions, _ = written(kept.groupBy("doc_id", "sentence").agg(ranked.alias("words"), F.any_value("labels").alias("labels")).select("words", "labels"), "transactions")
    grown, _ = written(patterns(transactions, max(2 * least_docs, 6), longest), "patterns")
    alone = grown.filter("label = ''").select("words", "n")
    together = grown.filter("label <> ''").select("words", "label", F.col("n").alias("n_label"))
    several = together.join(alone, "words").join(base, "label").withColumn("confidence", calibrated).filter("label <> '=none'").filter(pure).select("words", "label", "confidence", F.col("n").alias("support"))
    one = single.filter(pure).select(F.array("word").alias("words"), "label", "confidence", F.col("n").alias("support"))
    every = one.unionByName(several)
    w = F.col("words")
    subsets = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size(w)).cast("int") - 2), lambda bits: F.filter(w, lambda x, i: F.call_function("getbit", bits, i) == 1))
    parts = several.select("words", "label", "confidence", F.explode(subsets).alias("part")).join(every.select(F.col("words").alias("part"), "label", F.col("confidence").alias("of_part")), ["part", "label"])
    redundant = parts.filter("confidence <= of_part + 0.02").select("words", "label").distinct()
    lean = every.join(redundant, ["words", "label"], "left_anti")
    return lean.filter(F.col("confidence") >= sure).select("words", F.substring("label", 2, 100).alias("subject"), "confidence", "support")


def _scored(book: dict, sure: float):
    """book: first word -> [(words, subject, confidence)]."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                said, hits, evidence = sentences(text), {}, {}
                for s in said:
                    words, best = items(s), {}
                    here = set(words)
                    for w in words:
                        for needed, subject, confidence in book.get(w, ()):
                            if confidence > best.get(subject, 0) and here.issuperset(needed):
                                best[subject] = confidence
                    for subject, confidence in best.items():
                        if confidence >= sure:
                            hits[subject] = hits.get(subject, 0) + 1
                            evidence[subject] = evidence.get(subject, 0.0) + confidence
                for subject, n in hits.items():
                    for c, v in zip(out, (doc, subject, n, len(said), evidence[subject])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "subject", "hits", "sentences", "evidence"])

    return run


def subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, share: float = 0.2, sure: float = 0.6) -> DataFrame:
    """(doc_id, subject, hits, sentences, evidence) of every document and subject of at least the share."""
    book: dict[str, list] = {}
    for r in rules(docs, labels, areas, sure=sure).toLocalIterator():  # bounded by the sample
        book.setdefault(r["words"][0], []).append((frozenset(r["words"]), r["subject"], r["confidence"]))
    scored = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(book, sure), "doc_id long, subject string, hits int, sentences int, evidence double")
    return scored.filter(F.col("hits") >= F.lit(share) * F.col("sentences"))
