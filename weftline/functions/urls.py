"""URL rules: registered domain, file extension, shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.index import same_keys

# Registered domain names that are never kept.
DOMAINS = """
500px aapks akamaihd amazon apple artifactfire artstation awwni bandcamp battleforthenet
coinscalendar dailymotion deviantart discord discordapp dlapkandroid dropbox e621 ebay edealinfo
erome eroshare explosm facebook fbcdn flickr furaffinity futhead gatopardo gfycat
gifsound gifsoup giphy github google gunprime gyazo horsefucker hotdealstar imagefap
imageshack imgflip imgur instagram karmadecay kryptocal kym-cdn liveleak livememe lmgtfy
magaimg memegenerator minorplanetcenter minus mobafire morejpeg nocookie pcpartpicker photobucket pinimg
pinterest pixiv pornhub prntscr puu qkme quickmeme radd redd reddit
reddit-stream redditlog redditmedia reddituploads redtube reupp reverb roanoke rollingstone sli
soundcloud soundgasm spankbang spotify strawpoll streamable timeanddate tinypic touhouradio tumblr
twimg twitch twitter vid vimeo vine vkaao vocaroo voyagefusion walmart
wciu wikimedia wikipedia xhamster xkcd xvideos youtu youtube youtubedoubler ytimg zillexplorer
""".split()

# Endings of files that are not web text (".7z.ai" is one entry).
EXTENSIONS = """
.3gp .7z.ai .aif .apk .app .avi .bin .bmp .bz2 .css .csv .dat .deb .dmg .doc .docx .exe .gif .gifv .gz
.iso .jar .jpeg .jpg .js .log .mid .midi .mkv .mov .mp3 .mp4 .mpeg .mpg .ogg .ogv .otf .pdf .pkg .png
.pps .ppt .pptx .psd .py .qt .ram .rar .sql .svg .swf .tar.gz .tar .tgz .tiff .ttf .txt .wav .webm .wma
.wmv .xls .xlsx .xml .xz .zip
""".split()

# Common two-label public suffixes; longer lists are a parameter.
SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp co.nz co.za com.br com.cn com.mx co.in co.kr com.tr com.tw".split()

# Fixed value: shape of an accepted URL.
SHAPE = (
    r"^(?:http)s?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)"
    r"|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
)


def registered_domain(url: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """Label before the public suffix: two labels when listed, else one."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    pair = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    back = F.when(n == 1, 1).when(pair.isin(suffixes) & (n > 2), 3).otherwise(2)
    return F.when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), host).otherwise(F.element_at(labels, -back))


def url_filter(df: DataFrame, url: str, order: str, domains: list[str] = DOMAINS, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Reason per row, first rule that hits: domain, extension, short, malformed, duplicate, keep.

    The first of equal URLs (by ``order``) is found by a combined minimum, so a
    URL seen a billion times is no hot sort.
    """
    u = F.trim(F.col(url))
    path = F.lower(F.substring_index(u, "?", 1))
    ends = "(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$"
    ruled = df.withColumn("_rule", F.when(registered_domain(u, suffixes).isin(domains), "domain")
                          .when(path.rlike(ends), "extension")
                          .when(F.length(u) <= 8, "short")
                          .when(~u.rlike("(?i)" + SHAPE), "malformed")).withColumn("_u", u)
    firsts = ruled.filter("_rule is null").groupBy("_u").agg(F.min(order).alias("_first"))
    return same_keys(ruled, firsts, ["_u"], "left").withColumn(
        "status", F.coalesce("_rule", F.when(F.col(order) == F.col("_first"), "keep").otherwise("duplicate"))
    ).drop("_rule", "_u", "_first")
