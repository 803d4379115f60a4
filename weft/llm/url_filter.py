"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest
fitting rule gives the verdict. URLs that a rule judges are the labelled ones: the trees learn from a
bounded, hash-chosen sample of them and judge what no rule fits. Features: lengths of URL, host, path
and query, depth, labels, digit and letter ratios, entropy of characters, parameter counts, signs, and,
for the host's last one, two and three labels, the smoothed share of blocked URLs and their number.

Suffix counts are taken over all labelled URLs into a table of fixed size, by hashes of suffixes. A
row's statistics leave out the labelled URLs of its own host, in training and judging alike, so its own
label is in none of its features. A suffix whose other hosts are all blocked, or all allowed, says
nothing (share at the prior, number 0): a rule for one path of one host must not judge a whole
top-level domain.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged
by the trees like the empty URL; very long URLs are taken whole; of rules that fit with equal length
the one with the greater name decides; without labelled URLs, or with one verdict only, the trees give
the smoothed share of blocked ones; a probability of one half blocks; repeated rows each get a row;
null ids stay null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._common import hash_sample


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def ruled(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


# -- features ------------------------------------------------------------------------------------

LEXICAL = (
    "length", "host length", "path length", "query length", "depth", "labels", "digit ratio", "digits in host", "letter ratio",
    "entropy", "entropy of host", "parameters", "signs", "longest part", "secure", "fragment",
)
LEVELS = (1, 2, 3)
FEATURES = LEXICAL + tuple(f"{kind} {k}" for k in LEVELS for kind in ("share", "count"))


def entropy(row: np.ndarray, kind: np.ndarray, rows: int) -> np.ndarray:
    """Bits for each character of each row."""
    width = int(kind.max()) + 1 if len(kind) else 1
    pair, count = np.unique(row * width + kind, return_counts=True)
    n = np.bincount(row, minlength=rows)
    share = count / np.maximum(n[pair // width], 1)
    return np.bincount(pair // width, -share * np.log2(share), rows)


def lexical(urls: list[str | None]) -> np.ndarray:
    """The lexical features of a batch of URLs, from its characters in one array."""
    text = [u or "" for u in urls]
    rows, n = len(text), np.array([len(t) for t in text], np.int64)
    code = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(rows), n)
    at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    known, kind = np.unique(code, return_inverse=True)
    is_ = lambda test: np.array([test(chr(c)) for c in known], bool)[kind] if len(known) else np.empty(0, bool)
    same = lambda signs: is_(lambda c: c in signs)
    total = lambda mask: np.bincount(row[mask], minlength=rows)

    def first(mask: np.ndarray) -> np.ndarray:
        """The first place of each row where the mask holds, else its length."""
        out, hits = n.copy(), np.flatnonzero(mask)[::-1]
        out[row[hits]] = at[hits]
        return out

    slash, colon = same("/"), same(":")
    follows = lambda mask, by: np.append(mask[by:], np.zeros(min(by, len(mask)), bool)) & (at + by < n[row])
    scheme = first(colon & follows(slash, 1) & follows(slash, 2))
    host_at = np.minimum(scheme + 3, n)
    path_at = first((at >= host_at[row]) & same("/?#"))
    query_at = first((at >= path_at[row]) & same("?#"))
    fragment_at = first((at >= host_at[row]) & same("#"))
    in_host, in_path = (at >= host_at[row]) & (at < path_at[row]), (at >= path_at[row]) & (at < query_at[row])
    in_query = (at > query_at[row]) & (at < fragment_at[row])
    digit, letter, ampersand = is_(str.isdigit), is_(str.isalpha), same("&")
    word = is_(lambda c: c.isalnum() or c == "_")
    begins = in_query & ~ampersand & (np.append(True, ampersand[:-1])[: len(code)] | (at == query_at[row] + 1))
    run = np.cumsum(~word | (at == 0))[word]
    longest = np.zeros(rows)
    if len(run):
        runs, where, size = np.unique(run, return_index=True, return_counts=True)
        np.maximum.at(longest, row[word][where], size)
    most = np.maximum(n, 1)
    secure = np.array([t[:8].lower() == "https://" for t in text], float)
    columns = [
        n, total(in_host), total(in_path), total(in_query), total(in_path & slash), total(in_host & same(".")) + 1, total(digit) / most, total(digit & in_host),
        total(letter) / most, entropy(row, kind, rows), entropy(row[in_host], kind[in_host], rows), total(begins), total(~word & ~same("./:")),
        longest, secure, fragment_at + 1 < n,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


#: Cells of the table of suffix counts.
CELLS = 1 << 17


def suffix_cells(host: Column) -> Column:
    """The cells of the host, then of its last one, two and three labels (of all, where it has fewer)."""
    labels = F.split(host, "\\.")
    last = lambda k: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), F.lit(k)))
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), host if k == 0 else last(k)), F.lit(CELLS)).cast("int") for k in (0, *LEVELS)])


def suffix_counts(labelled: DataFrame) -> np.ndarray:
    """(blocked, all) labelled URLs by cell, over all rows of (cells, blocked); at most CELLS rows come back."""
    each = labelled.select(F.explode("cells").alias("cell"), "blocked").groupBy("cell").agg(F.sum("blocked").alias("b"), F.count("*").alias("n"))
    got, out = each.toArrow(), np.zeros((2, CELLS), np.int64)
    out[:, got.column("cell").to_numpy()] = got.column("b").to_numpy(), got.column("n").to_numpy()
    return out


def suffix_features(cells: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Share and number for each level, without the host's own labelled URLs; nothing where all others agree."""
    blocked, every = (c[cells[:, 1:]] - c[cells[:, :1]] for c in counts)
    blocked, every = np.maximum(blocked, 0), np.maximum(every, 0)
    says = (blocked > 0) & (blocked < every)
    share = np.where(says, (blocked + 2 * prior) / (every + 2), prior)
    return np.stack([share, np.where(says, np.log1p(every), 0.0)], 2).reshape(len(cells), 2 * len(LEVELS))


# -- gradient-boosted trees ----------------------------------------------------------------------


@dataclass
class Trees:
    """Trees as flat arrays: feature (-1 for leaves), threshold, left child (right is the next), value."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                following = left[at] + (x[every, f] > threshold[at])
                at = np.where(inner, following, at)
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic loss, second-order leaf values, splits over histograms of binned features."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, left, value = [-1], [0.0], [0], [0.0]
        place = np.zeros(len(y), np.int64)
        level = [0]
        for d in range(depth + 1):
            following = []
            for node in level:
                rows = np.flatnonzero(place == node)
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + ridge)
                if d == depth or len(rows) < 2:
                    continue
                gain, found = 1e-6, None
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                    gains = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gains[(hl < least) | (hs - hl < least)] = 0
                    if (k := int(gains.argmax())) >= 0 and gains[k] > gain:
                        gain, found = gains[k], (f, k)
                if found:
                    f, k = found
                    feature[node], threshold[node], left[node] = f, float(cuts[f][k]), len(feature)
                    place[rows] = len(feature) + (binned[rows, f] > k)
                    following += [len(feature), len(feature) + 1]
                    for a, empty in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
                        a += [empty, empty]
            level = following
        tree = (np.array(feature), np.array(threshold), np.array(left), np.array(value))
        model.trees.append(tree)
        margin += tree[3][place]
    return model


@dataclass
class UrlModel:
    trees: Trees
    counts: np.ndarray
    prior: float

    def matrix(self, urls: list[str | None], cells: np.ndarray) -> np.ndarray:
        return np.concatenate([lexical(urls), suffix_features(cells, self.counts, self.prior)], 1)

    def block_probability(self, urls: list[str | None], cells: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.trees.margin(self.matrix(urls, cells))))


def cell_matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), 1 + len(LEVELS))


def fit(urls: list[str], cells: np.ndarray, blocked: np.ndarray, counts: np.ndarray) -> UrlModel:
    """The trees from sampled URLs, with suffix counts over all labelled ones."""
    y = np.asarray(blocked, np.float64)
    model = UrlModel(Trees(0.0), counts, float((y.sum() + 1) / (len(y) + 2)))
    model.trees = boost(model.matrix(urls, cells), y)
    return model


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "blocked", most_rows: int = 10_000) -> UrlModel:
    """The model from labelled URLs (1 blocked, 0 allowed): counts over all, trees from at most ``most_rows``, chosen by a hash."""
    url = F.col(url_col).cast("string")
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(url.alias("url"), F.col(label_col).cast("int").alias("blocked"), suffix_cells(host_of(url)).alias("cells"))
    got = hash_sample(rows, most_rows, "url", "blocked").toArrow()
    return fit(got.column("url").to_pylist(), cell_matrix(got.column("cells").combine_chunks()), got.column("blocked").to_numpy(), suffix_counts(rows))


def by_rules(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, host, path, rule, ruled): the longest rule that fits each URL and its verdict, null where none does."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    return rows.select("*", ruled(rules, host, path, lambda r: r.name).alias("rule"), ruled(rules, host, path, lambda r: r.verdict).alias("ruled"))


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel | None = None, *, id_col: str = "page_id", url_col: str = "url", most_rows: int = 10_000) -> DataFrame:
    """(id, host, path, rule, verdict, block_probability); without a model one is trained on the ruled URLs."""
    rows = by_rules(pages, rules, id_col=id_col, url_col=url_col)
    if model is None:
        model = train(rows.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "block").cast("int").alias("blocked")), most_rows=most_rows)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(urls: pa.Array, cells: pa.Array) -> pa.Array:
        return pa.array(sent.value.block_probability(urls.to_pylist(), cell_matrix(cells)), pa.float64())

    return rows.select("*", probability("url", suffix_cells(F.col("host"))).alias("block_probability")).select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_probability",
    )
