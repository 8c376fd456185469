"""URL filters: path rules, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table (by default the
one below, 75 URLs of either kind); n-grams of host and path are hashed apart, so
the same letters may count for one and against in the other. Scoring needs the
weight vector alone, whose size is fixed, and one pass over the URLs.

Defined cases: a null URL or one without :// has empty host and path, no rule,
and the model's verdict on empty text; repeated rows give repeated rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import ROOT, lower_az, table

BUCKETS = 1 << 14
SIZES = (3, 4, 5)

#: verdict, host, path start; the longest that fits wins.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Labelled URLs (host and path), to block and to allow. Invented for this table.
BLOCKED = """
cheap-pills.example.com/buy/1 best-pills.example.org/order/now pills-online.example.net/cart discount-pills.example.com/sale order-pills.example.org/cheap
cheap-meds.example.net/buy/now meds-discount.example.org/order viagra-deals.example.net/order buy-viagra.example.com/cheap viagra-online.example.org/buy
online-casino.example.com/play casino-bonus.example.net/free-spins best-casino.example.org/bonus casino-online.example.com/jackpot royal-casino.example.net/play
slots-win.example.org/jackpot free-slots.example.com/spins win-slots.example.net/bonus poker-bonus.example.com/play online-poker.example.org/free-bonus
free-money.example.org/click win-money.example.com/free easy-money.example.net/fast fast-money.example.org/win make-money.example.com/easy
win-prize.example.com/claim/now free-prize.example.net/claim prize-winner.example.org/claim/free claim-prize.example.com/win get-rich-fast.example.net/easy-money
adult-cams.example.com/live live-cams.example.net/adult free-cams.example.org/sexy xxx-tube.example.net/watch free-xxx.example.com/tube
hot-singles.example.org/meet sexy-singles.example.com/hot meet-singles.example.net/sexy sexy-chat.example.com/free adult-chat.example.org/live-cams
warez-crack.example.net/keygen free-warez.example.org/download crack-keygen.example.com/serial free-keygen.example.net/crack cracked-apps.example.com/keygen
phish-login.example.com/verify/account verify-login.example.org/account/update account-verify.example.net/login secure-login-verify.example.com/account login-update.example.org/verify
replica-watches.example.org/sale cheap-replica.example.com/watches replica-bags.example.net/cheap buy-replica.example.org/sale replica-shop.example.com/watches/sale
payday-loan.example.org/apply fast-loan.example.com/payday loan-payday.example.net/cash cash-loan.example.org/fast easy-loan.example.com/payday/apply
seo-backlinks.example.com/buy cheap-backlinks.example.org/seo buy-backlinks.example.net/links spam-links.example.org/seo/buy link-farm.example.net/backlinks
spam-farm.example.org/spam/728 spam-blog.example.com/links spam-offers.example.net/click bulk-spam.example.org/offers click-spam.example.com/free
crypto-doubler.example.org/send double-crypto.example.com/free free-crypto.example.net/claim crypto-prize.example.org/double bitcoin-doubler.example.com/claim/free
""".split()
ALLOWED = """
news.example.org/world/2020/05 city-library.example.net/catalog/item/12 docs.example.com/guide/install university.example.org/physics/lecture/3 museum.example.net/exhibits/42
recipes.example.com/soup/tomato weather.example.org/forecast/week encyclopedia.example.net/wiki/river gardening.example.com/roses/pruning chess-club.example.org/openings
school.example.net/math/algebra travel.example.com/rome/walks journal.example.org/article/118 forum.example.net/topic/77 health.example.com/advice/sleep
music.example.org/scores/bach history.example.net/rome/empire code.example.com/project/readme science.example.org/biology/cell sports.example.net/results/2019
archive.example.com/books/12 gov.example.org/law/section/3 maps.example.net/trail/north films.example.com/review/9 poetry.example.org/sonnet/18
harbor-notes.example.org/en/120 www.riverside.example.com/en/418 blog.hillview.example.net/de/77 lantern.example.org/fr/331 m.orchard.example.com/es/902
meadow-press.example.net/en/15 www.oldmill.example.org/de/640 blog.northwind.example.com/fr/208 stonebridge.example.net/en/511 m.willow.example.org/es/84
www.cobalt-reading.example.com/en/733 fernhill.example.net/en/266 blog.saltmarsh.example.org/en/190 amberlight.example.com/de/905 m.quarry.example.net/fr/47
www.thistle.example.org/en/358 driftwood.example.com/es/672 blog.eastgate.example.net/en/829 copperfield.example.org/en/543 m.lakehouse.example.com/de/316
astronomy.example.org/planets/saturn botany.example.net/ferns/spores geology.example.com/rocks/basalt kitchen.example.org/bread/rye letters.example.net/archive/1912
painting.example.com/watercolour/paper rail-timetable.example.org/north/stations parish.example.net/register/1840 theatre.example.com/plays/hamlet birdwatch.example.org/warblers
teacher.example.net/lesson/fractions village.example.com/council/minutes observatory.example.org/nights/june printing.example.net/type/serif sailing.example.com/knots/bowline
dictionary.example.org/word/lantern hospital.example.net/visiting/hours court.example.com/decision/2018 seminar.example.org/logic/notes workshop.example.net/tools/plane
library.example.com/catalogue/maps survey.example.org/results/2021 orchestra.example.net/season/autumn nature.example.com/rivers/trout folklore.example.org/tales/winter
grammar.example.net/verbs/past market-town.example.com/history/church engineering.example.org/bridges/arch physics.example.net/optics/lens cycling.example.com/routes/coast
""".split()


def features(host: str, path: str) -> list[int]:
    """Buckets of the distinct n-grams of host and path."""
    found = set()
    for field, text in (("h", host), ("p", path)):
        marked = f"^{text}$"
        for n in SIZES:
            found.update(field + marked[i : i + n] for i in range(len(marked) - n + 1))
    return list({zlib.crc32(g.encode()) % BUCKETS for g in found})


def train(blocked=BLOCKED, allowed=ALLOWED, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3):
    """(weights, bias) of ridge logistic regression by gradient steps."""
    import numpy as np

    rows, labels = [], []
    for label, urls in ((1.0, blocked), (0.0, allowed)):
        for url in urls:
            host, slash, path = url.partition("/")
            rows.append(features(host, slash + path))
            labels.append(label)
    y, w, bias = np.array(labels), np.zeros(BUCKETS), 0.0
    scale = np.array([len(r) ** -0.5 for r in rows])
    at, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for _ in range(steps):
        z = np.bincount(owner, w[at], len(rows)) * scale + bias
        err = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(at, (err * scale)[owner], BUCKETS) / len(y) * 8 + ridge * w)
        bias -= rate * err.mean()
    return w, bias


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocked=BLOCKED, allowed=ALLOWED) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, 1: block)."""
    root = ROOT
    weights, bias = train(blocked, allowed)

    def run(batches):
        import sys

        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.urls import score

        for batch in batches:
            scores = [score(h, p, weights, bias) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "score"])

    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    parts = pages.select(F.col(id_col).alias("page_id"), after.alias("rest"))
    parts = parts.select("page_id", lower_az(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)).alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    rule = F.lit(None).cast("string")
    for _, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule is asked before a shorter one
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
    scored = parts.select("page_id", "host", "path", rule.alias("rule")).mapInArrow(run, "page_id long, host string, path string, rule string, score double")
    kinds = F.lit(None).cast("string")
    for kind, host, path in rules:
        kinds = F.when(F.col("rule") == host + path, kind).otherwise(kinds)
    return scored.select("page_id", "host", "path", "rule", F.coalesce(kinds, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def score(host: str, path: str, weights, bias: float) -> float:
    import math

    at = features(host, path)
    z = float(weights[at].sum()) * (len(at) or 1) ** -0.5 + bias
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
