"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visitors. Matched case-sensitively.
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "gclsrc", "gbraid", "wbraid", "_ga", "_gl", "_gac",
    "fbclid", "fb_action_ids", "fb_action_types", "fb_ref", "fb_source", "msclkid", "mc_cid", "mc_eid", "twclid", "t_co", "li_fat_id",
    "ref", "referrer", "referer", "source", "src", "campaign", "camp", "medium", "med", "content", "cnt", "term", "keyword",
    "email_campaign", "email_source", "em_campaign", "em_source", "pk_campaign", "pk_kwd", "pk_source", "pk_medium", "pk_content", "cmpid",
    "cmp", "igshid", "share_id", "shared_from", "affiliate", "aff", "aff_id", "affiliate_id", "_kx", "_ke", "klaviyo", "kl_email",
    "vero_id", "vero_conv", "yclid", "gad_source", "srsltid", "_hsenc", "_hsmi", "hsCtaTracking", "hsa_acc", "hsa_cam", "hsa_grp", "hsa_ad",
    "hsa_src", "hsa_tgt", "hsa_kw", "hsa_mt", "hsa_net", "hsa_ver", "wickedid", "wickedsource", "wickedplacement", "_bta_tid", "_bta_c",
    "trk_contact", "trk_msg", "trk_module", "trk_sid", "sp_cid", "sp_rid", "oft_id", "oft_k", "oft_lk", "oft_d", "oft_c", "oft_ck", "oftk",
    "oftid", "_branch_match_id", "_branch_referrer", "~channel", "~feature", "~campaign", "~stage", "~creation_source", "~referring_link",
    "~id", "s_cid", "s_kwcid", "ef_id", "s_trackingid", "icid", "ncid", "cid", "sid", "tid", "rid", "bid", "pid", "aid", "oid", "lid",
    "vid", "nid", "mid", "did", "wid", "uid", "tracking_id", "track_id", "trackid", "tracker", "track", "trkid", "trk_id", "tr_id",
    "tid_id",
)

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def page_id(url: Column, loaded_at: Column) -> Column:
    """md5 of `url:loaded_at`: the id of a visit, and of the tree that it roots."""
    return F.md5(F.concat_ws(":", url, loaded_at))


def host(url: Column) -> Column:
    """Lower-case host name without port and user; null for what is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def tracking_parameters(url: Column) -> Column:
    """The tracking parameter names that the URL carries, in order, repeats included."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    return F.filter(names, lambda n: n.isin(*TRACKING_PARAMETERS))


def _clean_query(query: Column) -> Column:
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING_PARAMETERS),
    )
    text = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    text = F.replace(text, F.lit("%20"), F.lit("+"))
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def normalize(url: Column) -> Column:
    """The URL without tracking parameters, for comparing navigation.

    Scheme and host become lower case, the scheme's default port goes, an empty path
    becomes /, the fragment stays. A parameter without a value gets an equals sign and an
    encoded space becomes a plus sign; other escapes are kept as they are. What is
    no http(s) URL keeps its text before ? and #, and its cleaned query.
    """
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, authority = F.lower(part(1)), F.lower(F.regexp_replace(part(2), "^.*@", ""))
    port = F.when(scheme == "https", ":443$").otherwise(":80$")
    path = F.when(part(3) == "", "/").otherwise(part(3))
    fragment = F.when(part(5) == "#", "").otherwise(part(5))
    whole = F.concat(
        scheme, F.lit("://"), F.regexp_replace(authority, port, F.lit("")), path, _clean_query(F.substring(part(4), 2, 1 << 30)), fragment
    )
    base = F.regexp_extract(url, "^([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(scheme.isin("http", "https") & (authority != ""), whole).otherwise(F.concat(base, _clean_query(query)))
