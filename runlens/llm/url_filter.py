"""URL verdicts from rules and a logistic regression on character n-grams.

Rules name a host and a path prefix; the longest that fits decides. URLs that no rule
fits get the verdict of a model on hashed n-grams of host and path, trained from a small
labelled table. Only DataFrame functions and Spark's own DataFrame-based
LogisticRegression are used; the weights are one bounded literal array.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of the n-grams, and how many weights they are hashed to.
GRAMS, BUCKETS = (3, 4, 5), 1 << 14
#: The model's pull to zero.
DECAY = 1e-5
#: Labelled rows that training takes at most; a larger table is refused.
LABELLED = 20_000
#: Rules that are written into the plan; more are joined by host.
LITERAL_RULES = 64

# The small labelled table, by host and path. Hosts are invented but for their last part.
_BLOCK = """
royal-casino-bonus.test/play casinoslots24.test/free-spins bestpokerroom.test/texas-holdem onlinebetting-tips.test/odds
sportbets.test/live/football jackpot-lottery.test/win/now roulette-strategy.test/ luckyslots.test/machines/777 bingo-cash.test/bonus-code
blackjack-club.test/tables megacasino.test/en/register betting-exchange.test/horse-racing gamblers-den.test/dice free-spins-slots.test/a1
hot-sexcams.test/live xxx-videos.test/tube/123 adult-porn-tube.test/teen nudegirls.test/gallery/9 escortgirls-city.test/berlin
webcam-sex-chat.test/join pornstars.test/models milf-dating.test/profiles erotic-massage.test/prices sexyladies.test/pics/44
cheapviagra.test/buy online-pharmacy-pills.test/order cialis-generic.test/discount buy-xanax-cheap.test/no-prescription weightloss-pills.test/miracle
dietpills-online.test/fast replica-watches.test/rolex fake-handbags.test/louis luxury-replicas.test/sale/2 viagra-pills.test/shop
warez-download.test/games cracked-software.test/photoshop keygen-serials.test/windows torrent-movies.test/download/hd free-cracks.test/serial-key
nulled-scripts.test/themes pirated-films.test/watch/free apk-mod-hacked.test/unlimited serialz.test/crack/office torrentz-mirror.test/search
account-verify-login.test/secure/update secure-bank-login.test/confirm paypall-verify.test/signin free-gift-cards.test/claim win-iphone-now.test/survey
you-won-prize.test/claim/1000 login-security-alert.test/password crypto-doubler.test/invest bitcoin-giveaway.test/send get-rich-quick.test/system
make-money-fast.test/home earn-cash-online.test/daily forex-robot-profit.test/signals payday-loans-fast.test/apply instant-loan-approval.test/bad-credit
debt-relief-now.test/free-quote click-here-free.test/offer doctors-hate-this.test/trick shocking-celebrity.test/photos you-wont-believe.test/story
miracle-cure.test/cancer hair-growth-secret.test/order ad-tracker.test/click/redirect popunder-ads.test/serve spyware-remover.test/download
adserver-traffic.test/banner buy-followers.test/instagram cheap-seo-links.test/backlinks linkfarm-directory.test/submit spam-mailer.test/bulk
""".split()
_ALLOW = """
citylibrary.test/catalogue/history university.test/faculty/physics museum-of-art.test/exhibitions primaryschool.test/class/3b townhall.test/services/waste
hospital-north.test/departments/cardiology weather-service.test/forecast/tomorrow gardeners-almanac.test/roses recipes-and-bread.test/sourdough national-park.test/trails/lakes
science-journal.test/volume/12/article open-data.test/datasets/rivers archive.test/papers/1999 dictionary.test/words/house encyclopedia.test/articles/volcano
newspaper-daily.test/politics/election localnews.test/2020/05/bridge-opens radio-station.test/programme/morning orchestra.test/concerts/spring theatre.test/tickets/season
railway-timetable.test/lines/4 bicycle-club.test/routes/coast mountain-hiking.test/huts sailing-school.test/courses football-club.test/fixtures/2021
bookshop.test/novels/new woodworking.test/forum/joints knitting-patterns.test/scarf astronomy-society.test/meteor chess-lessons.test/openings
programming-guide.test/python/functions linux-manual.test/man/ls database-docs.test/sql/joins developer.test/api/reference opensource-project.test/wiki/install
mathematics.test/algebra/groups physics-lectures.test/mechanics chemistry-lab.test/experiments biology-notes.test/cells geography.test/maps/africa
parliament.test/debates/2019 court-decisions.test/civil tax-office.test/forms/income employment-agency.test/vacancies post-office.test/parcel/track
church-choir.test/rehearsals community-centre.test/events volunteer-fire.test/members animal-shelter.test/dogs/adopt bird-watching.test/species/owl
blog-of-a-teacher.test/2018/lesson-plans my-travel-diary.test/italy/rome photography.test/portfolio/landscape painting-class.test/watercolour architecture-review.test/houses
car-repair-manual.test/brakes hardware-store.test/paint/white furniture-maker.test/tables farm-market.test/vegetables bakery.test/opening-hours
insurance-company.test/contact bank-branch.test/locations energy-supplier.test/meters water-works.test/quality internet-provider.test/support
film-festival.test/programme music-lessons.test/piano comics-fan.test/reviews boardgames.test/rules/chess video-lectures.test/course/statistics
health-advice.test/children/fever dentist.test/appointments nutrition.test/vitamins sports-medicine.test/knee pharmacy-museum.test/history
""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the small labelled table, label 1 for block; each entry with and without www."""
    rows = [(f"{start}{u}", label) for label, urls in ((1.0, _BLOCK), (0.0, _ALLOW)) for u in urls for start in ("https://", "http://www.")]
    return _local(spark, ["url string", "label double"], rows)


def _local(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small table as a relation of literals in the plan, which needs no Python worker."""
    data = F.from_json(F.lit(json.dumps([dict(zip((c.split()[0] for c in columns), r, strict=True)) for r in rows])), f"array<struct<{', '.join(c.replace(' ', ': ') for c in columns)}>>")
    return spark.range(1, numPartitions=1).select(F.inline(data))


def host(url: Column) -> Column:
    """What is after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What is behind the host up to ?, # or the end; else empty."""
    until = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.locate("/", until) > 0, until.substr(F.locate("/", until), F.length(until))).otherwise("")


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")


def _buckets(h: Column, p: Column) -> Column:
    """The weights' numbers of the n-grams of ^host/path$, repeats included."""
    text = F.concat(F.lit("^"), h, F.lit(" "), p, F.lit("$"))
    grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), _bucket_of(text, n)) for n in GRAMS]
    return F.concat(*grams)


def _bucket_of(text: Column, n: int):
    return lambda i: F.pmod(F.xxhash64(F.substring(text, i, n)), F.lit(BUCKETS)).cast("int")


def train(labelled: DataFrame, decay: float = DECAY) -> list[float]:
    """BUCKETS weights and the threshold, none: unknown n-grams alone allow. A feature is a bucket's n-grams
    over the root of all the URL's, so that long paths weigh no more. The labelled rows, LABELLED at
    most, are made sparse vectors on the driver."""
    rows = labelled.select("label", _buckets(host(F.col("url")), path(F.col("url"))).alias("b")).limit(LABELLED + 1).collect()
    if len(rows) > LABELLED:
        raise ValueError(f"a labelled table of over {LABELLED} rows")
    if len({r.label for r in rows}) < 2:
        return [0.0] * BUCKETS + [-1.0]  # nothing to tell apart: allow
    vectors = [(r.label, Vectors.sparse(BUCKETS, {i: c / len(r.b) ** 0.5 for i, c in Counter(r.b).items()})) for r in rows]
    frame = labelled.sparkSession.createDataFrame(vectors, ["label", "features"]).coalesce(1)
    model = LogisticRegression(regParam=decay, maxIter=100, standardization=False, fitIntercept=False).fit(frame)
    return [*model.coefficients.toArray().tolist(), float(model.intercept)]


def score(h: Column, p: Column, weights: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")  # folded to one literal
    b = _buckets(h, p)
    return F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(table, i)) / F.sqrt(F.size(b)) + F.lit(weights[-1])


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return _local(spark, ["verdict string", "host string", "path string"], rules)


def _best_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(n, rule, verdict), or null."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        fit = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        fits.append(F.when(fit, F.struct(F.lit(len(rule_host + rule_path)).alias("n"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(row, host, path) with `best`, by an equal join of each distinct host's suffixes with the rules' hosts."""
    hosts = urls.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = hosts.select("host", F.explode(suffixes).alias("suffix")).join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "verdict"), "suffix")
    each = F.struct(F.length(F.concat("suffix", "rule_path")).alias("n"), F.concat("suffix", "rule_path").alias("rule"), "verdict", "rule_path")
    by_host = fit.groupBy("host").agg(F.sort_array(F.collect_set(each), asc=False).alias("rules"))
    best = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), 0)
    return urls.join(by_host, "host", "left").withColumn("best", best).drop("rules")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url).

    rules: (verdict, host, path). A null URL or one without :// has an empty
    host and path and no rule; the model judges it like any other. URLs of any length are judged whole. Repeated rows each get a row, a
    null page_id stays null, an empty table gives an empty result, other
    columns are not read. Without rules the model judges all; without
    labelled rows it allows all. Equally long rules: the greater of (rule, verdict).
    """
    weights = train(labelled)
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    if len(rules) <= LITERAL_RULES:
        known = parts.withColumn("best", _best_rule(F.col("host"), F.col("path"), rules))
    else:
        known = _joined_rules(parts, rules_frame(pages.sparkSession, rules))
    model = F.when(score(F.col("host"), F.col("path"), weights) > 0, "block").otherwise("allow")
    return known.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", model).alias("verdict"))
