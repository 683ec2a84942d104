"""Document parsers as Arrow-batched functions: sample sheets, labelled samples, card sets and DOCX files.

Each takes a table of documents and gives rows per parsed sample; a document that does not parse gives
one row with ``error``. They are order-dependent within a document only, so they are plain maps.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import zip_longest
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The markers of the formats.
PAGE = re.compile(r"^[ \t]*Sample[ \t]+(\d+[ \t]*[A-C])[ \t]+(\d+)[ \t]+of[ \t]+(\d+)[ \t]*$", re.I | re.M)
COMMENTARY = re.compile(r"^[ \t]*Sample:[ \t]*(\d+[A-C])[ \t]*$", re.I | re.M)
TOTAL = re.compile(r"Total Score:[ \t]*(\d+)", re.I)
ROW = re.compile(r"^[ \t]*(Thesis|Contextualization|Evidence|Analysis and Reasoning)[ \t]*(?:Score)?:[ \t]*(\d+)", re.I | re.M)
LABEL = re.compile(r"^[ \t]*(?:Sample|Essay)[ \t]+#?(\d+)[ \t]*[-:][ \t]*(?:Score[ \t]*)?(\d)(?:/6)?[ \t]*$", re.I | re.M)
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

SAMPLES = "doc string, sample_id string, text string, total int, rows string, error string"


def parse_sheet(text: str) -> list[dict]:
    """Samples whose pages 1..N are all there (the longest text of each page), with the scores of their commentary."""
    parts = list(PAGE.finditer(text))
    cut = COMMENTARY.search(text)
    stop = cut.start() if cut else len(text)
    pages: dict[str, dict[int, str]] = {}
    size: dict[str, int] = {}
    for a, b in zip_longest(parts, parts[1:]):
        if a.start() > stop:
            break
        name = re.sub(r"\s", "", a[1]).upper()
        body = text[a.end() : min(b.start() if b else stop, stop)].strip()
        size[name] = max(size.get(name, 0), int(a[3]))
        if len(body) > len(pages.setdefault(name, {}).get(int(a[2]), "")):
            pages[name][int(a[2])] = body
    notes = list(COMMENTARY.finditer(text))
    scores = {}
    for a, b in zip_longest(notes, notes[1:]):
        own = text[a.end() : b.start() if b else len(text)]
        total = TOTAL.search(own)
        scores[a[1].upper()] = (int(total[1]) if total else None, {k.lower(): int(v) for k, v in ROW.findall(own)})
    found = []
    for name, own in sorted(pages.items()):
        total, rows = scores.get(name, (None, {}))
        missing = set(range(1, size[name] + 1)) - set(own)
        error = "missing_page" if missing else "row_sum_mismatch" if rows and total is not None and sum(rows.values()) != total else None
        found.append({"sample_id": name, "text": "\n".join(own[i] for i in sorted(own)), "total": total, "rows": json.dumps(rows), "error": error})
    return found


def parse_labelled(text: str, least: int = 100) -> list[dict]:
    """Blocks between label lines such as ``Sample 2: 4/6``; short ones are dropped."""
    parts = list(LABEL.finditer(text))
    found = []
    for a, b in zip_longest(parts, parts[1:]):
        body = re.sub(r"\s+", " ", text[a.end() : b.start() if b else len(text)]).strip()
        if len(body) >= least:
            found.append({"sample_id": a[1], "text": body, "total": int(a[2]), "rows": "{}", "error": None})
    return found


def parse_cards(text: str, least: int = 120) -> list[dict]:
    """A card set as JSON ``{title, terms: [{term, definition}]}``: a prompt card opens a group, thesis and body cards fill it."""
    try:
        cards = json.loads(text)
        terms, title = cards["terms"], cards.get("title", "")
    except (ValueError, KeyError, TypeError):
        return [{"sample_id": "", "text": "", "total": None, "rows": "{}", "error": "not_a_card_set"}]
    groups, current = [], {"prompt": title, "parts": []}
    for card in terms:
        term, said = str(card.get("term", "")).strip(), str(card.get("definition", "")).strip()
        if term.lower().startswith("prompt") or term.endswith("?"):
            groups.append(current)
            current = {"prompt": said if term.lower().startswith("prompt") else term, "parts": []}
            if not term.lower().startswith("prompt") and said:
                current["parts"].append(said)
        elif said:
            current["parts"].append(said)
    groups.append(current)
    whole = [(i, g, "\n".join(g["parts"])) for i, g in enumerate(groups)]
    return [{"sample_id": str(i), "text": body, "total": None, "rows": json.dumps({"prompt": g["prompt"]}), "error": None} for i, g, body in whole if len(body) >= least]


def docx_paragraphs(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p")]


def parse_docx(data: bytes) -> list[dict]:
    """Cases of ``Essay n`` paragraphs, their text, and a ``Scores: a b c d total t`` line; rejected where the rows don't add up."""
    try:
        lines = docx_paragraphs(data)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return [{"sample_id": "", "text": "", "total": None, "rows": "{}", "error": "not_a_docx"}]
    found, name, body = [], None, []
    for line in lines:
        head = re.fullmatch(r"\s*Essay\s+(\d+)\s*", line, re.I)
        score = re.fullmatch(r"\s*Scores?:\s*(\d)\s+(\d)\s+(\d)\s+(\d)\s+total\s+(\d)\s*", line, re.I)
        if head:
            name, body = head[1], []
        elif score and name is not None:
            rows, total = [int(x) for x in score.groups()[:4]], int(score[5])
            found.append({"sample_id": name, "text": "\n".join(body).strip(), "total": total, "rows": json.dumps(rows), "error": None if sum(rows) == total else "row_sum_mismatch"})
            name = None
        elif name is not None and line.strip():
            body.append(line.strip())
    return found


def parse_documents(docs: DataFrame, name: str, content: str, parser: Callable[[str], list[dict]] | Callable[[bytes], list[dict]]) -> DataFrame:
    """Samples of every document of a table."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"doc": key, **row} for key, value in zip(batch["doc"], batch["content"], strict=True) if value is not None for row in parser(value)]
            out = pd.DataFrame(rows, columns=["doc", "sample_id", "text", "total", "rows", "error"])
            out["total"] = out["total"].astype("Int32")
            yield out

    return docs.select(F.col(name).cast("string").alias("doc"), F.col(content).alias("content")).mapInPandas(parse, SAMPLES)


def read_files(spark, path: str, pattern: str = "*") -> DataFrame:
    """``(path, content, text, sha256)`` of files; page text of PDFs must be extracted beforehand."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))
