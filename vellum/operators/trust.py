"""Whether signers chain to a trusted root: certificates joined to their issuers, link by link.

Nothing is verified cryptographically and revocation isn't looked up: the operator works on what certificates say.  ``certificates`` holds (cert, subject,
issuer, valid_from, valid_to, is_ca), ``anchors`` holds (cert) of trusted roots, ``signers`` holds (sig, cert, at).  A chain ends at a certificate
that issued itself.  Several certificates may bear an issuer's name, so chains branch; a signer is trusted if one of its branches is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.sources.scratch import discard, written

#: What can be wrong with a chain, in the order in which it is told.
PROBLEMS = ("certificate not valid at the time", "issuer is no authority", "issuer not found", "root not trusted", "chain leads back to itself", "chain too long")
_TIME, _AUTHORITY, _PARTIAL, _ROOT, _CYCLE, _LONG = (1 << i for i in range(len(PROBLEMS)))


def _bit(when, bit: int):
    return F.when(F.coalesce(when, F.lit(False)), F.lit(bit)).otherwise(F.lit(0))


def trust(signers: DataFrame, certificates: DataFrame, anchors: DataFrame, longest: int = 16) -> DataFrame:
    """(sig, status, root, links, details) of each signer.

    ``status`` is Trusted, Untrusted, or Indeterminate where the signer's certificate is missing or names no subject or issuer.  Of several
    branches the one with the fewest problems counts (then one that ends at a root, then the shortest, then the least root).  One equi-join for each link, up to
    ``longest``; each level is a written table, so a deep chain has no deep lineage; a certificate that stands in its own chain ends it.
    Signers that share a certificate and a time are walked once.
    """
    c = certificates.select("cert", "subject", "issuer", "valid_from", "valid_to", "is_ca")
    trusted = anchors.select("cert").distinct().withColumn("anchor", F.lit(True))
    c = written(c.join(trusted, "cert", "left"), "certificates")
    asked = signers.select("cert", "at").distinct()
    timed = lambda: _bit((F.col("at") < F.col("valid_from")) | (F.col("at") > F.col("valid_to")), _TIME)
    first = asked.join(c, "cert").where("subject IS NOT NULL AND issuer IS NOT NULL")
    level = written(first.select("cert", "at", F.col("cert").alias("tip"), "subject", "issuer", "anchor", F.array("cert").alias("chain"), timed().alias("wrong")), "chain")
    ends, tables = [], []
    for n in range(1, longest + 1):
        at_root = F.col("subject") == F.col("issuer")
        ends.append(level.where(at_root).select("cert", "at", F.col("subject").alias("root"), F.lit(n).alias("links"), F.col("wrong").bitwiseOR(_bit(F.col("anchor").isNull(), _ROOT)).alias("wrong")))
        onward = level.where(~at_root).select("cert", "at", "chain", "wrong", F.col("issuer").alias("name"))
        issuers = c.where("issuer IS NOT NULL").select(F.col("cert").alias("tip"), F.col("subject").alias("name"), "subject", "issuer", "anchor", "valid_from", "valid_to", "is_ca")
        joined = onward.join(issuers, "name", "left")
        back = F.array_contains("chain", F.coalesce("tip", F.lit("")))
        wrong = F.col("wrong").bitwiseOR(timed()).bitwiseOR(_bit(~F.col("is_ca"), _AUTHORITY)).bitwiseOR(_bit(F.col("tip").isNull(), _PARTIAL)).bitwiseOR(_bit(back, _CYCLE))
        step = written(joined.select("cert", "at", "tip", "subject", "issuer", "anchor", F.concat("chain", F.array("tip")).alias("chain"), wrong.alias("wrong"),
            (F.col("tip").isNull() | back).alias("over")), "chain")
        ends.append(step.where("over").select("cert", "at", F.lit(None).cast("string").alias("root"), F.lit(n).alias("links"), "wrong"))
        tables += [level, step]
        level = step.where("NOT over")
        level._scratch_path = step._scratch_path
        if level.isEmpty():
            break
    else:
        ends.append(level.select("cert", "at", F.lit(None).cast("string").alias("root"), F.lit(longest).alias("links"), F.col("wrong").bitwiseOR(F.lit(_LONG)).alias("wrong")))
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)
    best = every.groupBy("cert",
        "at").agg(F.min(F.struct(F.bit_count("wrong").alias("n"), F.col("root").isNull().alias("open"), "links", F.coalesce("root", F.lit("")).alias("root_name"), "wrong")).alias("b"))
    best = written(best, "trust")
    discard(*{t._scratch_path: t for t in (*tables, c)}.values())
    found = signers.join(best, ["cert", "at"], "left")
    status = F.when(F.col("b").isNull(), "Indeterminate").when(F.col("b.wrong") == 0, "Trusted").otherwise("Untrusted")
    told = F.array_join(F.filter(F.array(*[F.when(F.col("b.wrong").bitwiseAND(1 << i) != 0, F.lit(p)) for i, p in enumerate(PROBLEMS)]), lambda x: x.isNotNull()), "; ")
    return found.select("sig", status.alias("status"), F.nullif(F.col("b.root_name"), F.lit("")).alias("root"), F.col("b.links").alias("links"), told.alias("details"))
