"""URL filters: an allow/block rule table, then a logistic model of hashed character n-grams.

The model is a logistic regression on the character n-grams of host and path,
hashed into `BUCKETS` counts.  It is trained by gradient descent on a small
labelled URL table (`EXAMPLES`, or one of the caller's with columns url, label
and at most `MOST_EXAMPLES` rows; more are an error); the fitted weights are
bounded by `BUCKETS`.  Scoring uses built-in functions only.  The table lists
what URLs of gambling, pharmacy, pornography, loan, fraud, piracy and link
selling tend to hold, and ordinary sites; it is no sample of any data set.
Hosts whose names say nothing are the rule and not the exception, so it also
holds invented names, made by a rule: alone and beside ordinary words, to allow, and
beside words of what is to be blocked.

A page is blocked from the score on at which no more than `FALSE_POSITIVES` of the
table's URLs to allow would be, each scored by a model that has seen no URL of its host
(`FOLDS` folds).

Defined results: a null url, an empty one, or one without `://`, has empty host
and path and no rule; it is judged by the model, whose score is then near its
bias.  Of rules of equal length on one host the longest path wins, then the
longest host.  Each row is judged for itself, so repeated rows and null ids get
equal results, urls of any length are read whole, and an empty table gives an empty one.
Columns host, path, rule, score and verdict of the input are replaced.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 16384
GRAMS = (3, 4, 5)
ROUNDS = 300
RATE = 60.0
L2 = 0.00003
#: Folds of the table, and the share of URLs to allow that may be blocked out of fold.
FOLDS, FALSE_POSITIVES = 5, 0.05
MOST_EXAMPLES = 10_000

# The rule table of the query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# A small labelled URL table: what to block, and what to allow.
BLOCK = """
https://www.royal-casino-slots.example/bonus/welcome http://megapoker.test/play/holdem?ref=77 https://sportsbetting-odds.test/live/football http://roulette.luckyspin.example/en/register
https://bingo-jackpot.example/promo/2023/free-spins https://bookmaker-bet.test/signup#offer http://slotmachine-online.test/games/12 https://blackjack.vegaswin.example/table/5
https://poker-freeroll.example/tournament.html https://lottery-winner.test/claim-your-prize https://casinobonus.test/no-deposit/ http://betting-tips.example/sure-win/today
http://cheap-pharmacy.test/buy/viagra-online https://cialis-discount.example/order.php?id=9 https://www.pillstore.test/no-prescription/tramadol http://rx-meds.example/buy-cheap-pills
https://weightloss-diet.test/miracle-pill/ https://canadian-drugs.example/cart/xanax http://buyviagra.example/ https://painkillers-now.test/oxycodone/order https://ed-pills.test/generic/levitra
https://steroids-shop.example/buy/anabolic http://herbal-enlargement.test/results
https://xxx-videos.test/hd/ http://porn-tube.example/watch/8812 https://www.sexcams.test/live/girls https://adult-dating.example/hookup/near-you http://nude-pics.test/gallery/3
https://escort-girls.example/city/list https://hotmilf.test/free-porn/ http://webcam-sex.example/model/77 https://erotic-xxx.test/stories https://adultfriend.test/join https://nudecams.example/room/4
https://payday-loans.example/instant-cash/apply http://quick-credit.test/no-credit-check https://fastcash-loan.test/apply-now https://debt-relief.example/consolidate http://badcredit-loans.example/approved
https://crypto-doubler.test/invest/btc-profit http://forex-signals.example/get-rich https://earn-money-fast.test/work-from-home http://binary-options.example/profit https://bitcoin-giveaway.test/claim
https://mlm-income.example/passive-money http://pyramid-invest.test/guaranteed-returns
http://secure-login.paypa1-verify.example/account/confirm https://bank-update.test/verify-password http://apple-id-locked.example/signin https://account-suspended.test/login.php http://free-iphone-winner.example/survey
https://gift-card-generator.test/free/ http://prize-claim.example/winner?id=1 https://virus-alert.test/call-support http://your-pc-infected.example/scan http://tech-support-scam.test/1-800
https://cracked-software.test/keygen/download http://warez-torrent.example/full-movie https://free-movies-stream.test/watch-online http://serial-keys.example/crack/win https://mp3-download-free.example/torrent
https://apk-mod-hack.test/unlimited-coins http://game-cheats-hack.example/generator https://torrent-pirate.test/top100
http://buy-backlinks.example/seo-packages https://cheap-seo-links.test/order https://link-exchange.example/directory/submit http://buy-followers.test/instagram https://get-likes.example/youtube-views
https://article-spinner.test/auto-content http://replica-watches.example/rolex-cheap https://fake-handbags.test/louis-discount http://cheap-jerseys.example/outlet/sale https://replica-shoes.test/wholesale
https://click-ads-network.test/banner?z=3 http://popunder-ads.example/serve.js https://adserver.test/track/pixel.gif http://tracking-click.example/redirect?u=1 https://affiliate-offers.test/go/991
https://casino.test/ http://onlinepoker.example/casino http://betwin.example/bonus-code https://pharmacy-pills.example/buy/cheap https://buypills.test/discount https://freexxx.example/porn/tube
http://sexchat.test/cams/adult https://cashloan.example/payday http://free-crypto.test/bitcoin/bonus https://adclick.example/banner http://freedownload-crack.test/keygen https://spamlinks.example/seo/buy
""".split()
ALLOW = """
https://www.riverside-library.example/catalogue/new-arrivals http://history-museum.test/exhibitions/bronze-age https://university.example/physics/lectures/12 https://weather-station.test/forecast/week
https://www.cityhall.example/council/minutes/2021 http://kitchen-garden.test/recipes/tomato-soup.html https://mathnotes.example/algebra/groups https://botanic-society.test/plants/oak
https://dailyherald.example/news/world/2020/04/elections http://localpaper.test/sport/results https://science-weekly.example/articles/black-holes https://magazine.test/culture/review-of-the-year
https://docs.pythonista.example/tutorial/strings http://linux-users.test/forum/thread/8812 https://compilers.example/blog/parsing https://database-internals.test/btree.html https://opensource.example/projects/editor
https://developer-guide.test/api/v2/reference http://algorithms.example/sorting/merge https://kernel-notes.test/scheduler
https://parish-church.example/events/easter http://village-school.test/parents/calendar https://primary-school.example/classes/3b https://teachers-union.test/resources https://kindergarten.example/about
https://hospital.example/departments/cardiology http://nursing-college.test/admissions https://dentist-clinic.example/opening-hours https://health-advice.test/vaccines/measles http://blood-donors.example/find-a-centre
https://walking-trails.test/routes/coast-path http://cycling-club.example/rides/sunday https://mountain-huts.test/bookings https://sailing-school.example/courses http://birdwatching.test/sightings/heron
https://chess-club.example/openings/sicilian https://marathon.test/training-plan http://rowing.example/regatta/2019 https://orchestra.test/season/concerts https://choir.example/rehearsals
https://poetry-archive.test/authors/keats http://theatre-company.example/plays/hamlet https://film-institute.test/silent-era https://gallery-of-art.example/collections/prints http://jazz-festival.test/programme
https://bakery.example/bread/sourdough http://coffee-roasters.test/beans/ethiopia https://vineyard.example/tasting-notes https://farm-shop.test/seasonal/vegetables https://cheese-makers.example/cheddar
https://hardware-store.test/tools/hammers http://bookshop.example/fiction/new https://furniture.test/tables/oak https://bicycle-repair.example/brakes http://knitting-patterns.test/jumpers/winter
https://railway-timetable.example/stations/north http://airport.test/arrivals https://ferry.example/crossings/islands https://bus-service.test/routes/42 https://travel-journal.example/lisbon/day-3
https://court-records.test/cases/2018 http://parliament.example/bills/education https://statistics-office.test/census/tables https://tax-office.example/forms/annual http://embassy.test/visas
https://astronomy.example/observatory/log http://geology-survey.test/maps/limestone https://ocean-institute.example/tides https://chemistry.test/elements/iron http://genetics-lab.example/papers/fly
https://dictionary.test/words/umbrella https://encyclopedia.example/wiki/lighthouse http://translation.test/french/verbs https://grammar-guide.example/commas https://spelling.test/lists/year-4
https://philosophy.example/ethics/kant http://economics.test/lectures/inflation https://genealogy.example/families/miller https://photography.test/portraits/light http://pottery.example/glazes
https://volunteers.test/projects/river-clean https://housing-association.example/tenants http://fire-brigade.test/safety/smoke-alarms https://animal-shelter.example/dogs/adopt https://food-bank.test/donate
https://engineering.example/bridges/suspension http://architecture.test/brick/arches https://electronics.example/circuits/filters https://solar-energy.test/panels/roof http://wind-power.example/turbines
https://art-school.test/ http://old-bridge.example/history https://north-coast.test/walks/map https://readers-club.example/books/free-verse https://cinema.test/win-or-lose/review https://addressbook.example/help
http://trackandfield.test/results/100m https://pillow-makers.test/about https://betterhomes.example/kitchen http://cheapside-market.test/stalls
""".split()
#: Words that stand beside invented names: ordinary ones, and ones of what is to be blocked.
ORDINARY = """
apple archive autumn basket beach book bread bridge brush butter button candle carpet castle chair church circle clock cloud coast cotton country cousin desert doctor dragon eagle engine family farm
feather fence finger forest fountain garden ghost glass grain guitar hammer harbour harvest honey horse island jacket journey kettle kitchen ladder lake lamp leaf lesson library lunch machine market
meadow mirror mountain museum needle ocean office orange painter paper pencil piano picture planet pocket portrait potato rabbit rain river rocket saddle sailor school scissors shadow silver soup
spring stable station stone story summer sunrise teacher thunder ticket tiger timber tower tractor travel treasure tunnel valley village violin wagon water weather wheel window winter wood yellow
""".split()
SUSPECT = """
casino poker slots jackpot betting roulette blackjack bingo lottery gambling viagra cialis pharmacy pills tramadol xanax steroid drugstore prescription levitra porn nude sexcam erotic hookup escort
milf webcam adult fetish payday loan credit cashfast debt forex bitcoin profit investment richquick giveaway winner prize claim verify password suspended locked survey cracked keygen torrent warez serial
piracy cheats hack generator backlinks followers replica rolex outlet counterfeit popunder adserver banner affiliate clickbait spam bonus freespins instantcash cheapmeds bestdeal discount
""".split()
#: Invented names: alone, beside two ordinary words, and beside two suspect ones; and the seed.
ALONE, WITH_ORDINARY, WITH_SUSPECT, SEED = 400, 400, 300, 8


def _invented() -> list[tuple[str, int]]:
    """URLs of hosts with invented names; to block are those beside suspect words."""
    r = random.Random(SEED)
    plain = "article archive news item view page post story category topic index docs about team blog photo map list guide".split()
    ending = ("com", "org", "net", "info", "io", "eu", "example", "test")

    def name() -> str:
        return "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(("", "", "n", "r", "s", "th", "nd", "l")) for _ in range(r.randint(2, 4)))

    def path() -> str:
        parts = [r.choice((r.choice(plain), str(r.randint(1, 99999)), name(), r.choice(("en", "de", "fr", "es", "it")), f"{r.randint(1999, 2024)}")) for _ in range(r.randint(0, 3))]
        return "/" + "/".join(parts) + r.choice(("", "/", ".html", ".php")) * bool(parts)

    def host(*said: str) -> str:
        own = [*said, name()] if r.random() < 0.3 or not said else list(said)
        return r.choice(("", "www.", "m.", "blog.", "shop.", name() + ".")) + r.choice(("", "-")).join(r.sample(own, len(own))) + r.choice(("", "." + name())) + "." + r.choice(ending)

    def url(words: list[str] | None) -> str:
        scheme = r.choice(("http", "https"))
        if words is None:
            return f"{scheme}://{host()}{path()}"
        two, where = r.sample(words, 2), r.random()
        if where < 0.4:
            return f"{scheme}://{host(*two)}{path()}"
        return f"{scheme}://{host(two[0])}/{two[1]}{path()}" if where < 0.7 else f"{scheme}://{host()}/{two[0]}-{two[1]}{path()}"

    return [(url(None), 0) for _ in range(ALONE)] + [(url(ORDINARY), 0) for _ in range(WITH_ORDINARY)] + [(url(SUSPECT), 1) for _ in range(WITH_SUSPECT)]


EXAMPLES = tuple((url, 1) for url in BLOCK) + tuple((url, 0) for url in ALLOW) + tuple(_invented())


class Model(NamedTuple):
    """Weights by bucket, bias, the score from which on a page is blocked, and the shares of URLs to allow and to block that are blocked out of fold."""

    weights: list[float]
    bias: float
    block_at: float
    false_positives: float
    recall: float


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), else null."""
    cases = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if cases is None else cases


def grams_of(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path; the two parts never share a bucket by their text alone."""

    def part(text: Column, mark: str) -> Column:
        marked = F.concat(F.lit(mark), text, F.lit("$"))

        def grams(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
            return F.transform(starts, lambda i: F.pmod(F.crc32(F.concat(F.lit(mark), F.substring(marked, i, F.lit(n))).cast("binary")), F.lit(BUCKETS)).cast("int"))

        return F.concat(*[grams(n) for n in GRAMS])

    return F.concat(part(host, "^"), part(path, "|"))


def _descend(grams: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent over all rows at once; a row's grams share its weight by their root."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not grams:
        return weights, bias
    sizes = np.array([len(g) for g in grams])
    scale, flat, own = 1 / np.sqrt(np.maximum(sizes, 1)), np.concatenate(grams), np.repeat(np.arange(len(grams)), sizes)
    for _ in range(ROUNDS):
        z = bias + scale * np.bincount(own, weights[flat], len(grams))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(grams)
        weights = weights - RATE * (L2 * weights + np.bincount(flat, (error * scale)[own], BUCKETS))
        bias -= RATE * float(error.sum())
    return weights, bias


def _scores(model: tuple[np.ndarray, float], grams: list[np.ndarray]) -> np.ndarray:
    return np.array([1 / (1 + np.exp(-(model[1] + model[0][g].sum() / np.sqrt(max(1, len(g)))))) for g in grams])


def fit(examples: DataFrame) -> Model:
    """The model of the labelled table, of which the driver reads MOST_EXAMPLES rows at most.

    Rows without a label are left out; a table without rows to allow blocks from 0.5 on.
    """
    url = F.col("url")
    described = examples.select(host_of(url).alias("host"), grams_of(host_of(url), path_of(url)).alias("grams"), "label").where("label is not null")
    rows = described.orderBy("host", "grams", "label").limit(MOST_EXAMPLES + 1).collect()
    if len(rows) > MOST_EXAMPLES:
        raise ValueError(f"the labelled table has more than {MOST_EXAMPLES} rows")
    grams, labels = [np.array(r.grams, np.int64) for r in rows], np.array([float(r.label) for r in rows])
    fold = np.array([zlib.crc32(r.host.encode()) % FOLDS for r in rows])
    apart = np.zeros(len(rows))
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(inside) and len(outside):
            apart[inside] = _scores(_descend([grams[i] for i in outside], labels[outside]), [grams[i] for i in inside])
    allowed = np.sort(apart[labels == 0])
    # So many of the highest scores of URLs to allow may be blocked; the cut lies just above the next one.
    most = int(FALSE_POSITIVES * len(allowed))
    block_at = float(np.nextafter(allowed[len(allowed) - 1 - most], 2)) if len(allowed) else 0.5
    share = lambda own: float((own >= block_at).mean()) if len(own) else 0.0
    weights, bias = _descend(grams, labels)
    return Model([float(w) for w in weights], bias, block_at, share(allowed), share(apart[labels == 1]))


def with_score(df: DataFrame, model: Model, host: str = "host", path: str = "path") -> DataFrame:
    """Adds score (0 to 1, higher: block likelier)."""
    table_ = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")  # one literal instead of one for each weight
    grams = grams_of(F.col(host), F.col(path))
    z = F.aggregate(grams, F.lit(0.0), lambda total, g: total + F.get(table_, g)) / F.sqrt(F.size(grams).cast("double"))
    return df.withColumn("score", 1 / (1 + F.exp(-(z + F.lit(model.bias)))))


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, examples: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule, score and verdict to each row; columns of these names are replaced."""
    spark = df.sparkSession
    examples = examples if examples is not None else spark.createDataFrame(EXAMPLES, "url string, label int")
    model = fit(examples)
    made = ("host", "path", "rule", "score", "verdict")
    kept = F.struct(F.col(f"`{url}`").alias("url"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in df.columns if c not in made]).alias("rest"))
    # The row travels as one struct, so that no name of its columns can meet a name of this function.
    parts = df.select(kept.alias("row")).select("row", host_of(F.col("row.url")).alias("host"), path_of(F.col("row.url")).alias("path"))
    scored = with_score(parts, model).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= model.block_at, "block").otherwise("allow"))
    others = [F.col(f"row.rest.`{c}`").alias(c) for c in df.columns if c not in made]
    return scored.select(*others, "host", "path", F.col("found.rule").alias("rule"), "score", verdict.alias("verdict"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
