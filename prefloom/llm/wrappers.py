"""Main text of web pages by wrapper induction.

The pages of a host are aligned with its smallest one by simple tree matching. Nodes that keep their
text from page to page are template; the slot in which texts vary and are not links or marked as
something else is the content. Every page is aligned anew with the wrapper of its host and gives
the blocks of its content slot. Alignments travel as skeletons: names, sizes and hashes of texts.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from prefloom.llm.common import steps, stored, texts_of
from prefloom.llm.markup import CONTENT, Block, read

# A text is template if so large a share of at least so many different aligned pages has it.
SHARE, PAGES = 0.8, 3
# Inside the content slot longer texts are never template: articles quote each other.
NOTE_CHARS = 100
# The slot is the innermost container with this share of the varying text.
SLOT = 0.9
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr ul ol dl figcaption caption".split())
LAYOUT = frozenset("div section form header span table tbody tr td".split())
COLUMNS = 7  # of a skeleton: name, size, hash of own text, own characters, those in links, aside, container


def _articles(block, aside=False):
    """Articles of a tree that no marked block holds, or with `aside` all."""
    return sum(
        (b.tag in CONTENT) + _articles(b, aside) for b in block.blocks() if aside or not b.aside
    )


def listed(root):
    """(blocks, skeleton) of a tree in document order; the skeleton has a row per block."""
    blocks, rows = [], []
    # A page whose only articles stand in marked blocks has marked what holds the page.
    spared = not _articles(root) and _articles(root, True) > 0

    def walk(block, aside):
        at = len(blocks)
        aside = aside or block.aside and not (spared and block.tag in LAYOUT and _articles(block, True))
        blocks.append(block)
        own = [item for item in block.items if not isinstance(item, Block)]
        text = "\n".join(item[0] for item in own)
        rows.append([
            xxhash.xxh32_intdigest(block.tag), 1, xxhash.xxh64_intdigest(text) >> 1, len(text), sum(x[1] for x in own),
            aside, block.tag in CONTENT or block.tag not in LEAF,
        ])
        for child in block.blocks():
            walk(child, aside)
        rows[at][1] = len(blocks) - at

    walk(root, False)
    return blocks, np.array(rows, dtype=np.int64).reshape(-1, COLUMNS)


def _children(skeleton, at):
    found, child, end = [], at + 1, at + skeleton[at][1]
    while child < end:
        found.append(child)
        child += skeleton[child][1]
    return found


def aligned(one, other):
    """Matched rows (of one, of other) of two skeletons by simple tree matching: names agree, order
    and parents are kept, and as many rows as possible match."""
    one, other = one.tolist(), other.tolist()
    known, paths = {}, {}

    def weight(a, b):
        if one[a][0] != other[b][0]:
            return 0
        if one[a][1] == 1 or other[b][1] == 1:
            return 1
        if (a, b) not in known:
            rows, columns = _children(one, a), _children(other, b)
            table = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
            for i, x in enumerate(rows, 1):
                line, above = table[i], table[i - 1]
                for j, y in enumerate(columns, 1):
                    line[j] = max(line[j - 1], above[j], above[j - 1] + weight(x, y))
            known[a, b] = table[-1][-1] + 1
            paths[a, b] = rows, columns, table
        return known[a, b]

    pairs, open_pairs = [], [(0, 0)] if weight(0, 0) else []
    while open_pairs:
        a, b = open_pairs.pop()
        pairs.append((a, b))
        if (a, b) in paths:
            rows, columns, table = paths[a, b]
            i, j = len(rows), len(columns)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    open_pairs.append((rows[i], columns[j]))
    return sorted(pairs)


def slot_of(skeleton, chars):
    """The row of the innermost container that holds most of the text, given characters per row."""
    sums = np.concatenate([[0], np.cumsum(chars)])
    within = sums[np.arange(len(skeleton)) + skeleton[:, 1]] - sums[:-1]
    fit = np.flatnonzero((within >= SLOT * within[0]) & (skeleton[:, 6] == 1) & (skeleton[:, 5] == 0))
    return int(fit[-1]) if len(fit) and within[0] else 0


def _plain(skeleton):
    """Characters of each row that are neither links nor marked as something else."""
    return np.where(skeleton[:, 5] == 1, 0, np.maximum(skeleton[:, 3] - skeleton[:, 4], 0))


def _skeleton(data):
    return np.frombuffer(data, dtype="<i8").reshape(-1, COLUMNS)


def host_of(url):
    """The host of a url: lower case, without user, port, path; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)


def skeletons(pages):
    """(host, skeleton, size) of every page."""

    def run(batches):
        for batch in steps(batches, "html"):
            found = [listed(read(html))[1] for html in texts_of(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([x.astype("<i8").tobytes() for x in found], pa.binary()), pa.array(list(map(len, found)), pa.int32())],
                ["host", "skeleton", "size"],
            )

    return pages.select("host", "html").mapInArrow(run, "host STRING, skeleton BINARY, size INT")


def induced(spark, pages):
    """(host, wrapper, slot, template): each host's smallest page as a skeleton, the row of its
    content slot and the rows whose text is template."""
    # Pages that are alike in all texts count once.
    different = stored(spark, skeletons(pages).distinct())
    smallest = different.groupBy("host").agg(F.min(F.struct("size", F.xxhash64("skeleton").alias("tie"), "skeleton")).alias("x"))
    smallest = stored(spark, smallest.select("host", F.col("x.skeleton").alias("wrapper")))

    def vote(batches):
        for batch in batches:
            counts = {}
            for host, page, wrapper in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                one, other = _skeleton(wrapper), _skeleton(page)
                if host not in counts:
                    counts[host] = np.zeros((len(one), 3), dtype=np.int64)
                a, b = np.array(aligned(one, other), dtype=np.int64).reshape(-1, 2).T
                counts[host][a, 0] += 1
                counts[host][a, 1] += one[a, 2] == other[b, 2]
                counts[host][a, 2] += _plain(other)[b]
            hosts = np.repeat(np.arange(len(counts)), [len(x) for x in counts.values()])
            rows = np.concatenate([np.zeros((0, 3), np.int64), *counts.values()])
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in counts.values()]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(counts)[i] for i in hosts], pa.string()), *map(pa.array, (at, *rows.T))],
                ["host", "at", "matched", "same", "chars"],
            )

    votes = different.join(smallest, "host").select("host", "skeleton", "wrapper").mapInArrow(
        vote, "host STRING, at BIGINT, matched BIGINT, same BIGINT, chars BIGINT"
    )
    sums = votes.groupBy("host", "at").agg(*[F.sum(name).alias(name) for name in ("matched", "same", "chars")])
    # A row per block of one page.
    by_host = sums.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "matched", "same", "chars"))).alias("rows"))

    def decide(batches):
        for batch in batches:
            slots, templates = [], []
            for wrapper, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                skeleton = _skeleton(wrapper)
                matched, same, chars = (np.array([row[name] for row in rows], dtype=np.int64) for name in ("matched", "same", "chars"))
                constant = (matched >= PAGES) & (same >= SHARE * matched) & (skeleton[:, 3] > 0)
                slots.append(slot_of(skeleton, np.where(constant, 0, chars)))
                templates.append(np.flatnonzero(constant).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(slots, pa.int32()), pa.array(templates, pa.list_(pa.int32()))],
                ["host", "wrapper", "slot", "template"],
            )

    return smallest.join(by_host, "host").mapInArrow(decide, "host STRING, wrapper BINARY, slot INT, template ARRAY<INT>")


def main_text(html, wrapper, slot, template):
    """The blocks of a page's content slot, one a line."""
    blocks, skeleton = listed(read(html))
    pairs = aligned(wrapper, skeleton)
    place = dict(pairs)
    constant = {place[row] for row in template if row in place}
    chars = _plain(skeleton)
    chars[list(constant)] = 0
    start = place.get(slot)
    own = np.concatenate([[0], np.cumsum(chars)])
    if start is None or slot == 0 or own[start + skeleton[start][1]] == own[start]:
        # No content where the host's pages have it: the page's own articles, or its largest container.
        starts = [i for i, b in enumerate(blocks) if b.tag in CONTENT and not skeleton[i][5]]
        starts = starts or [slot_of(skeleton, chars)]
    else:
        starts = [start]
        # More articles beside the slot belong to it.
        if blocks[start].tag in CONTENT:
            starts = [i for i, b in enumerate(blocks) if b.tag == blocks[start].tag and not skeleton[i][5]]
    lines, end = [], 0
    for start in starts:
        if start >= end:
            end = start + int(skeleton[start][1])
            lines += _lines(blocks, skeleton, start, constant)
    return "\n".join(lines)


def _lines(blocks, skeleton, start, constant):
    """Texts of the blocks from a row on, in page order; what an inline part interrupts stays one block."""
    order = {id(blocks[i]): i for i in range(start, start + int(skeleton[start][1]))}
    lines = []

    def walk(block):
        at = order[id(block)]
        if skeleton[at][5]:
            return
        held, glued = [], False
        for item in block.items:
            if isinstance(item, Block):
                if item.flows:
                    glued = True
                    continue
                walk(item)
                glued = False
            elif at not in constant or skeleton[at][3] >= NOTE_CHARS:
                if glued and held and lines:
                    lines[-1] = f"{lines[-1]} {item[0]}"
                else:
                    lines.append(item[0])
                    held.append(item)
                glued = False

    walk(blocks[start])
    return lines


def extracted(frame, id_column="page_id", url_column="url", html_column="html"):
    """page_id, url, text and n_chars of every row.

    A null html is empty and gives an empty text; pages without a host form one group. Rows of equal
    id or text each give a row. Character references are decoded, white space in a block is one
    space, blocks are joined by a line break. Other columns are left out.
    """
    spark = frame.sparkSession
    pages = frame.select(
        F.col(id_column).alias("page_id"),
        F.col(url_column).alias("url"),
        F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"),
        host_of(F.col(url_column).cast("string")).alias("host"),
    )
    wrappers = stored(spark, induced(spark, pages))

    def run(batches):
        for batch in steps(batches, "html"):
            known, texts = {}, []
            rows = zip(*[batch.column(name).to_pylist() for name in ("html", "host", "wrapper", "slot", "template")])
            for html, host, wrapper, slot, template in rows:
                if host not in known:
                    known[host] = _skeleton(wrapper), slot, template
                texts.append(main_text(html, *known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {name: kind for name, kind in pages.dtypes}
    return pages.join(wrappers, "host").select("page_id", "url", "html", "host", "wrapper", "slot", "template").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text STRING, n_chars BIGINT"
    )


def op13_main_text(spark, folder):
    return extracted(spark.read.parquet(f"{folder}/pages.parquet"))
