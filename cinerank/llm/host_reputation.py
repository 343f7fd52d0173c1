"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host. The rate of bad pages
is shrunk through beta-binomial priors: the corpus rate is the prior mean of a
suffix (com), the suffix's posterior mean that of a registered domain
(example.com), and the domain's that of a host. How strongly each level shrinks
is estimated from how much its units scatter around their priors (method of
moments). A host is blocked when the lower bound of its posterior (mean less
`z` standard deviations) lies above `worst`, so a host with few labelled pages
is blocked only where its whole domain is bad.

The registered domain is one label more than the longest suffix rule that fits
(`SUFFIX_RULES`, a parameter: plain rules, "*." for any one label, "!" for an
exception whose suffix is one label shorter); without one the suffix is the last
label. User, port and a final dot are left out of the name; an address is its own
domain, and all addresses share the empty suffix.

A rule is a host and a path prefix, allow or block; it fits its host and all
subdomains if the url's path starts with its path, and the longest one wins over
the reputation.

Cases: a null url, or one without "://", has empty host and path; the empty host
is a host like any other; pages without outcome are judged, not counted; with
no outcomes at all nothing is blocked; repeated page rows are each judged and
each counted; a page with several outcomes counts by majority, bad on a tie; no
pages give no rows; extra columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import materialise

WORST, Z = 0.35, 1.645
FIRST_RATE = 0.1  # the corpus rate's own prior, worth one page
LEAST_RHO, MOST_RHO = 0.001, 0.5


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    raw = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


# Suffixes under which names are registered, as registries publish them.
SUFFIX_RULES = tuple("""
co.uk org.uk me.uk ltd.uk plc.uk net.uk ac.uk gov.uk sch.uk nhs.uk police.uk *.sch.uk
com.au net.au org.au edu.au gov.au asn.au id.au
co.nz net.nz org.nz ac.nz govt.nz school.nz geek.nz gen.nz
co.jp ne.jp or.jp ac.jp ad.jp ed.jp go.jp gr.jp lg.jp *.kawasaki.jp !city.kawasaki.jp *.kobe.jp !city.kobe.jp
co.kr ne.kr or.kr re.kr pe.kr go.kr ac.kr
com.cn net.cn org.cn gov.cn edu.cn ac.cn com.hk org.hk edu.hk gov.hk com.tw org.tw edu.tw gov.tw com.sg org.sg edu.sg gov.sg
co.in net.in org.in gen.in firm.in ind.in ac.in edu.in gov.in co.id or.id ac.id go.id com.my org.my gov.my co.th or.th ac.th go.th
com.br net.br org.br gov.br edu.br com.ar org.ar gob.ar edu.ar com.mx org.mx gob.mx edu.mx com.co org.co gov.co edu.co
com.pe com.ve com.ec com.uy com.tr org.tr gov.tr edu.tr co.il org.il ac.il gov.il com.sa com.eg com.pk com.ph com.vn com.ua
co.za org.za ac.za gov.za net.za co.ke or.ke ac.ke com.ng org.ng com.gh com.pl net.pl org.pl edu.pl com.es org.es com.pt com.gr
co.at or.at ac.at gv.at com.ru
*.ck !www.ck *.er *.fk *.kh *.mm *.np *.pg *.bd *.jm
github.io gitlab.io blogspot.com appspot.com herokuapp.com netlify.app vercel.app pages.dev web.app
""".split())


def site_name(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?\z", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$")


def _last(name: Column, labels: Column) -> Column:
    return F.call_function("substring_index", name, F.lit("."), -labels)


def suffix_labels(name: Column, rules: tuple[str, ...] = SUFFIX_RULES) -> Column:
    """How many labels at the end of a name are its suffix."""
    n = F.size(F.split(name, r"\."))
    found = F.lit(1)
    by_length: dict[tuple[str, int], list[str]] = {}
    for r in rules:
        kind = r[0] if r[0] in "*!" else ""
        tail = r[2:] if kind == "*" else r.lstrip("!")
        by_length.setdefault((kind, r.count(".") + 1), []).append(tail)
    for (kind, k), tails in sorted(by_length.items(), key=lambda x: (x[0][0] == "!", x[0][1])):  # longer ones go on top, exceptions last
        tail = F.substring_index(name, ".", -(k - 1 if kind == "*" else k))
        found = F.when((n >= k) & tail.isin(tails), k - 1 if kind == "!" else k).otherwise(found)
    return found


def registered_domain(host: Column, rules: tuple[str, ...] = SUFFIX_RULES) -> Column:
    name = site_name(host)
    return F.when(is_address(name), name).otherwise(_last(name, suffix_labels(name, rules) + 1))


def suffix(host: Column, rules: tuple[str, ...] = SUFFIX_RULES) -> Column:
    name = site_name(host)
    return F.when(is_address(name), "").otherwise(_last(name, suffix_labels(name, rules)))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits. Rules
    are (verdict, "host/path") pairs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # later ones, the longer, go on top
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(r)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _shrink(units: DataFrame, prior: Column, level: str) -> DataFrame:
    """Units (n, k) with a prior mean, plus the level's concentration m and
    their posterior mean. rho is the excess of the squared deviations over
    binomial ones, within [LEAST_RHO, MOST_RHO]."""
    units = units.withColumn("mu", prior)
    spread = units.agg(F.sum((F.col("k") - F.col("n") * F.col("mu")) ** 2 - F.col("n") * F.col("mu") * (1 - F.col("mu"))).alias("over"),
                       F.sum(F.col("n") * (F.col("n") - 1) * F.col("mu") * (1 - F.col("mu"))).alias("scale"))
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), F.coalesce(
        F.when(F.col("scale") > 0, F.col("over") / F.col("scale")), F.lit(LEAST_RHO))))
    m = spread.select((1 / rho - 1).alias("m")).scalar()
    return units.withColumn(f"{level}_m", F.lit(m)).withColumn(
        f"{level}_mean", (F.col("k") + F.col(f"{level}_m") * F.col("mu")) / (F.col("n") + F.col(f"{level}_m"))).drop("mu")


def host_posteriors(outcomes: DataFrame, suffix_rules: tuple[str, ...] = SUFFIX_RULES) -> DataFrame:
    """host, n, k, mean, sd from rows (host, bad 0/1 or null). Every host of
    `outcomes` gets a row, with or without outcomes."""
    hosts = (outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
             .withColumn("domain", registered_domain(F.col("host"), suffix_rules))
             .withColumn("suffix", suffix(F.col("host"), suffix_rules)))
    hosts = materialise(hosts, "hosts")  # every level above is summed from this table
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    corpus = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + FIRST_RATE) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("r")).scalar()
    suffixes = _shrink(suffixes, F.lit(corpus), "s").select("suffix", "s_mean")
    domains = _shrink(domains.join(suffixes, "suffix"), F.col("s_mean"), "d").select("domain", "d_mean")
    post = _shrink(hosts.drop("suffix").join(domains, "domain"), F.col("d_mean"), "h")
    size = F.col("n") + F.col("h_m")
    return post.select("host", "n", "k", F.col("h_mean").alias("mean"),
                       F.sqrt(F.col("h_mean") * (1 - F.col("h_mean")) / (size + 1)).alias("sd"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], worst: float = WORST,
          z: float = Z, suffix_rules: tuple[str, ...] = SUFFIX_RULES) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule,
    verdict, host_labelled, host_bad. outcomes: (page_id, bad 0/1)."""
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    one = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(
        (F.avg("bad") >= 0.5).cast("int").alias("bad"))
    post = host_posteriors(parts.select("page_id", "host").join(one, "page_id", "left").select("host", "bad"), suffix_rules)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("mean") - z * F.col("sd") > worst, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(post, "host").select("page_id", "host", "path", rule.alias("rule"),
                                           F.coalesce(verdict, own).alias("verdict"),
                                           F.col("n").alias("host_labelled"), F.col("k").alias("host_bad"))
