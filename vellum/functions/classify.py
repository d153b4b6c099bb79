"""Ladders that sort findings into classes; the first rung that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def permission(mask: Column, bit: int) -> Column:
    """Bit ``bit`` of a permission mask, counted from 1."""
    return F.shiftright(mask, bit - 1).bitwiseAND(1) == 1


def permissions(mask: Column) -> list[Column]:
    """What a mask allows; filling forms follows from two bits, printing well needs two."""
    return [
        permission(mask, 3).alias("can_print"), permission(mask, 4).alias("can_modify"), permission(mask, 5).alias("can_copy"), permission(mask, 6).alias("can_annotate"),
        (permission(mask, 9) | permission(mask, 6)).alias("can_fill"), (permission(mask, 3) & permission(mask, 12)).alias("can_print_well"),
    ]


def visual_difference(m: dict[str, Column]) -> Column:
    """Category of a visual difference; the first rung that fits decides (fixed rungs and values).

    ``m``: diff (share of pixels), mae, luminance and chroma (mean steps of differing pixels), region, region_width,
    region_height and region_density of the greatest region, dark_balance, and pixels of the page.
    """
    diff, mae, chroma, dark, pixels, density = (m[c] for c in ("diff", "mae", "chroma", "dark_balance", "pixels", "region_density"))
    share = m["region"].cast("double") / pixels
    short, long = F.least(m["region_width"], m["region_height"]), F.greatest(m["region_width"], m["region_height"])
    aspect = F.when(short == 0, 0.0).otherwise(long.cast("double") / F.nullif(short, F.lit(0)))
    great, small = share >= 0.01, (pixels <= 10_000) & (m["region"] < 100) & (dark >= 0.5)
    return (
        F.when(diff == 0, "none").when((diff <= 0.002) & (mae <= 2), "minor-noise-or-antialiasing").when((m["luminance"] <= 18) & (mae <= 24), "color-tone-or-texture")
        .when((mae <= 12) & (chroma >= 12) & (dark >= 0.75), "color-tone-or-texture")
        .when(great & ((density < 0.3) | (aspect >= 8)) & (dark >= 0.75) & (mae <= 20), "localized-linework-or-texture")
        .when(great & (density >= 0.6) & (chroma >= 12) & (diff <= 0.35), "localized-color-or-image-content")
        .when(great & (density < 0.5) & (mae >= 8), F.when(small, "small-text-antialiasing").otherwise("localized-text-or-geometry"))
        .when(small & (diff >= 0.005), "small-text-antialiasing").when(great & (mae >= 12), "localized-content-or-geometry")
        .when((diff >= 0.08) & (mae >= 12), "structural-or-missing-content-candidate").otherwise("mixed")
    )


def impact(kind: Column, diff: Column, mae: Column) -> Column:
    """What a difference means to a reader: none, low, medium or high (fixed rungs and values)."""
    by_share = F.when(diff >= 0.03, "high").otherwise("medium")
    return (
        F.when(kind == "none", "none").when(kind.isin("minor-noise-or-antialiasing", "small-text-antialiasing"), "low")
        .when(kind == "color-tone-or-texture", F.when(mae <= 16, "low").otherwise("medium")).when(kind.isin("localized-color-or-image-content",
            "localized-linework-or-texture"), "medium")
        .when(kind == "structural-or-missing-content-candidate", "high").when(kind.isin("localized-text-or-geometry", "localized-content-or-geometry"), by_share)
        .when((diff <= 0.01) & (mae <= 5), "low").when((diff >= 0.08) & (mae >= 16), "high").otherwise("medium")
    )


#: Words in messages that tell a failure's kind, case aside (fixed values).
_COMPRESSION = ("compression", "compressed", "deflate", "zlib", "unsupported filter", "unsupported stream")
_PASSWORD = ("password verification failed", "requires a non-empty user password", "requiring a non-empty user password")


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def failure(phase: Column, error: Column, messages: Column, kinds: Column, stack: Column) -> Column:
    """Class of a failure from the phase, the error's type, and the types and messages of it and its causes.

    Types are "geometry", "limit", "encryption", "data", "parse", "overflow", "format", "unsupported" or others.
    """
    said = F.lower(F.concat_ws("\n", messages))
    compressed, locked = _any_in(said, _COMPRESSION), _any_in(said, _PASSWORD)
    unsupported = F.exists(F.arrays_zip(kinds.alias("kind"), messages.alias("message")),
        lambda x: (x["kind"] == "unsupported") & F.contains(F.lower(x["message"]), F.lit("filter")))
    decoding = F.exists(kinds, lambda k: k.isin("parse", "data")) | unsupported | F.contains(stack, F.lit("StreamDecompressor")) | F.contains(stack, F.lit(".Filters."))
    opened = (
        F.when(error == "encryption", F.when(locked, "PASSWORD_REQUIRED").otherwise("UNSUPPORTED_ENCRYPTED")).when((error == "data") & compressed, "UNSUPPORTED_COMPRESSION")
        .when(error.isin("parse", "data", "overflow", "format"), "MALFORMED_PDF").otherwise("PARSE_ERROR")
    )
    return F.when(error == "geometry", "INVALID_PAGE_GEOMETRY").when(error == "limit", "RESOURCE_LIMIT").when(phase == "open", opened).when(decoding,
        "DECODE_ERROR").otherwise("RENDER_ERROR")


_DEGENERATE = ("MALFORMED_PDF", "EMPTY_DOC", "PASSWORD_REQUIRED", "INVALID_PAGE_GEOMETRY")


def quality_ladders(e: dict[str, Column], c: dict[str, Column], strict: bool = False) -> dict[str, Column]:
    """What a scanned page is worth, from its entry and its contract (fixed rungs and names).

    ``e``: status, result, best, agreeing, compared, pairs, disagreeing, rank, release.  ``c``: known, primary, review,
    root_cause, reason, notes, target_reason, has_target.
    """
    status, zero = e["status"], F.lit(0)
    one, compared, agreeing, disagreeing = status == "PASS_ONE", F.coalesce(e["compared"], zero), F.coalesce(e["agreeing"], zero), F.coalesce(e["disagreeing"], zero)

    def said(x: Column) -> Column:
        return F.length(F.trim(F.coalesce(x, F.lit("")))) > 0

    quality = (
        F.when(status == "PASS", "PIXEL_EXACT").when(one, "MATCHES_ACCEPTED_REFERENCE").when(status == "ALL_ORACLES_REFUSED", "REFERENCE_REFUSAL_ACCEPTED")
        .when(status.isin("RECOVERED_MALFORMED_CONTENT", "RESOURCE_LIMIT", *_DEGENERATE), "NON_RENDERABLE_ACCEPTED").when(status == "DIFF", "FAIL")
        .when(F.coalesce(e["result"] == "PASS", F.lit(False)), "GOOD_ENOUGH").otherwise("FAIL")
    )
    quality = F.when(~c["known"], "NEEDS_REVIEW").otherwise(quality) if strict else quality
    target = said(c["primary"]) & F.coalesce(e["best"] == c["primary"], F.lit(False))
    split = F.when(target, "MATCHES_TARGET").when(agreeing == 1, "MATCHES_ONE_REFERENCE").otherwise("MATCHES_SOME")
    outlier = one & (compared >= 3) & (((agreeing == 1) & (F.coalesce(e["pairs"], zero) > 0) & (disagreeing == 0)) | ((agreeing <= 1) & (F.coalesce(e["rank"], zero) >= 3)))
    marks = F.lower(F.concat_ws("\n", c["reason"], c["notes"], c["target_reason"]))
    generated = F.coalesce(c["root_cause"] == "FULL_CORPUS_BASELINE", F.lit(False)) | _any_in(marks, ("baseline", "auto-classified", "promote to a reviewed contract"))
    review = (
        F.when(~one, "NOT_APPLICABLE").when(F.coalesce(e["release"].isin("BLOCKED", "FAIL"), F.lit(False)) | (quality == "FAIL"), "REJECTED").when(~c["known"], "UNREVIEWED")
        .when(c["review"] == "REVIEWED", "ACCEPTED").when(c["review"].isin("GENERATED", "NEEDS_REVIEW"), "UNREVIEWED")
        .when(generated | outlier | ~c["has_target"] | ~(said(c["reason"]) | said(c["notes"])), "UNREVIEWED").otherwise("ACCEPTED")
    )
    return {
        "quality": quality,
        "pixel_agreement": F.when(status == "PASS", "MATCHES_ALL_REQUIRED").when(one, split).when(status == "DIFF", "MATCHES_NONE").otherwise("NOT_COMPARABLE"),
        "references": F.when(status == "ALL_ORACLES_REFUSED", "REFS_REFUSE").when(compared == 0, "REFS_INCOMPLETE").when(disagreeing > 0, "REFS_DISAGREE").otherwise("REFS_AGREE"),
        "target_basis": (
            F.when(status.isin(*_DEGENERATE), "MALFORMED_INPUT_POLICY").when(status.isin("RESOURCE_LIMIT", "TIMEOUT"),
                "RESOURCE_POLICY").when(status == "ALL_ORACLES_REFUSED", "QUALITY_STANDARD")
            .when(one, "REFERENCE_DISAGREEMENT").otherwise("REFERENCE_CONSENSUS")
        ),
        "priority": F.when(status == "DIFF", "P1").when(one, "P2").otherwise("NONE"),
        "confidence": F.when(status == "PASS", "HIGH").when(one, F.when(compared >= 3, "MEDIUM").otherwise("LOW")).otherwise("MEDIUM"),
        "review": review,
        "outlier": outlier,
    }


def settled_agreement(status: Column, proposed: Column, inferred: Column) -> Column:
    """A contract's pixel agreement, unless the status speaks against it."""
    return (
        F.when((status == "PASS_ONE") & (proposed == "MATCHES_NONE"), inferred).when((status == "PASS") & (proposed != "MATCHES_ALL_REQUIRED"), "MATCHES_ALL_REQUIRED")
        .when((status == "DIFF") & ~proposed.isin("MATCHES_NONE", "NOT_COMPARABLE"), "MATCHES_NONE").otherwise(proposed)
    )


def disagreement_bucket(pairs: Column, disagreeing: Column) -> Column:
    """How many of the compared pairs of renderers disagree: unmeasured, none, some or all."""
    return F.when(F.coalesce(pairs <= 0, F.lit(True)) | disagreeing.isNull(), "unmeasured").when(disagreeing <= 0, "none").when(disagreeing >= pairs, "all").otherwise("some")


def link_target(action: Column, uri: Column) -> Column:
    """internal, external or dangerous, with what makes it so; null for links that lead nowhere."""
    scheme = F.lower(F.regexp_extract(F.trim(uri), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    by_uri = (
        F.when(F.trim(F.coalesce(uri, F.lit(""))) == "", None).when(scheme.isin("http", "https", "mailto"), "external")
        .when(scheme == "", "dangerous: URI:malformed").otherwise(F.concat(F.lit("dangerous: URI:"), scheme))
    )
    return F.when(action == "GoTo", "internal").when(action == "URI", by_uri).when(action.isin("Launch", "GoToE", "GoToR"), F.concat(F.lit("dangerous: "), action))


def link_kind(uri: Column) -> Column:
    """internal, external or dangerous; null for a blank link."""
    scheme = F.lower(F.regexp_extract(F.trim(uri), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(F.trim(F.coalesce(uri, F.lit(""))) == "", None).when(F.trim(uri).startswith("#"),
        "internal").when(scheme.isin("http", "https", "mailto"), "external").otherwise("dangerous")
