"""One entry point with the surface's parameter names, for users who switch.

``query(cat, list="recentchanges", rcprop={"ids"}, rcstart=...)`` and
``query(cat, titles={...}, prop={"links"}, plnamespace=0)`` translate prefixed
parameters to the keyword arguments of ``lists``, ``pageset`` and ``props``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lorekeep.operators import lists, pageset
from lorekeep.sources.catalog import Catalog

_TIME = {"start": "start", "end": "end", "dir": "direction", "limit": "limit"}
_LISTS = {
    "recentchanges": ("rc", lists.recent_changes, lists.shape_recent_changes, {
        **_TIME, "namespace": "namespace", "user": "user", "excludeuser": "exclude_user", "tag": "tag",
        "prop": "prop", "show": "show", "type": "types", "toponly": "top_only"}),
    "logevents": ("le", lists.log_events, lists.shape_log_events, {
        **_TIME, "user": "user", "title": "title", "namespace": "namespace", "tag": "tag", "type": "type",
        "action": "action", "prop": "prop"}),
    "allpages": ("ap", lists.all_pages, lists.shape_pages, {
        "from": "start", "to": "end", "dir": "direction", "prefix": "prefix", "namespace": "namespace",
        "filterredir": "redirects", "minsize": "min_size", "maxsize": "max_size", "prtype": "pr_type",
        "prlevel": "pr_level", "prexpiry": "pr_expiry", "prfiltercascade": "pr_cascade", "limit": "limit"}),
    "protectedtitles": ("pt", lists.protected_titles, lists.shape_protected_titles, {
        **_TIME, "namespace": "namespace", "level": "level", "prop": "prop"}),
    "allrevisions": ("arv", lists.all_revisions, lists.shape_revisions, {
        **_TIME, "namespace": "namespace", "user": "user", "excludeuser": "exclude_user", "prop": "prop",
        "slots": "slots"}),
    "alldeletedrevisions": ("adr", lists.all_deleted_revisions, lambda df: lists.shape_revisions(df, "ar_"), {
        **_TIME, "namespace": "namespace", "user": "user", "excludeuser": "exclude_user", "tag": "tag",
        "from": "title_from", "to": "title_to", "prop": "prop", "slots": "slots"}),
    "allusers": ("au", lists.all_users, lists.shape_users, {
        "from": "start", "to": "end", "dir": "direction", "group": "group", "excludegroup": "exclude_group",
        "witheditsonly": "with_edits_only", "prop": "prop", "limit": "limit"}),
}
_REV = {**_TIME, "user": "user", "excludeuser": "exclude_user", "prop": "prop", "slots": "slots"}
_ENTRIES = {"dir": "entry_direction", "limit": "entry_limit"}
_REVERSE = {"prop": "prop", "namespace": "namespace", "show": "show", "limit": "entry_limit"}
_PROPS = {
    "info": ("in", {"prop": "display_title"}), "pageprops": ("pp", {"prop": "names"}),
    "latestrevisions": ("rv", _REV), "revisions": ("rv", _REV),
    "deletedrevisions": ("drv", {**_REV, "tag": "tag"}),
    "templates": ("tl", {"namespace": "namespace", "templates": "titles", **_ENTRIES}),
    "links": ("pl", {"namespace": "namespace", "titles": "titles", **_ENTRIES}),
    "transcludedin": ("ti", _REVERSE), "linkshere": ("lh", _REVERSE), "redirects": ("rd", _REVERSE),
    "images": ("im", _ENTRIES), "categories": ("cl", _ENTRIES),
    "langlinks": ("ll", {"lang": "lang", "title": "title", **_ENTRIES}),
    "iwlinks": ("iwl", {"prefix": "prefix", "title": "title", **_ENTRIES}),
    "extlinks": ("el", {"protocol": "protocol", "query": "query", "limit": "entry_limit"}),
    "sections": ("sec", {"limit": "entry_limit"}),
}


def _arguments(params: dict, prefix: str, names: dict[str, str]) -> dict:
    """Take the parameters of one module out of ``params``; unknown ones are left.

    Contents have one slot, so ``slots`` may name only that.
    """
    out = {}
    for name, argument in names.items():
        if prefix + name not in params:
            continue
        value = params.pop(prefix + name)
        if name == "limit" and value == "max":
            continue
        if name == "slots":
            if value not in ("main", "*") and set(value) != {"main"}:
                raise ValueError(f"unknown slots {value!r}")
            continue
        out[argument] = value
    return out


def query(cat: Catalog, **params) -> DataFrame:
    """Run a list query, or a page-set query with properties, with prefixed parameters."""
    if "list" in params:
        name = params.pop("list")
        if name not in _LISTS:
            raise ValueError(f"unknown list {name!r}")
        prefix, build, shape, names = _LISTS[name]
        arguments = _arguments(params, prefix, names)
        if params:
            raise ValueError(f"unused parameters {sorted(params)}")
        return shape(build(cat, **arguments))
    prop = params.pop("prop", set())
    prop = {prop} if isinstance(prop, str) else set(prop)
    if "titles" in params:
        titles = params.pop("titles")
        pages = pageset.by_titles(cat, {titles} if isinstance(titles, str) else titles)
    elif "pageids" in params:
        ids = params.pop("pageids")
        pages = pageset.by_ids(cat, {ids} if isinstance(ids, int) else ids)
    elif "generator" in params:
        name = params.pop("generator")
        if name not in pageset.GENERATORS:
            raise ValueError(f"unknown generator {name!r}")
        prefix, _, _, names = _LISTS[name]
        pages = pageset.by_list(cat, name, **_arguments(params, "g" + prefix, names))
    else:
        raise ValueError("give list, titles, pageids or generator")
    options = {}
    taken: dict = {}
    for name in prop:
        if name not in _PROPS:
            raise ValueError(f"unknown property {name!r}")
        prefix, names = _PROPS[name]
        given = {**params}
        arguments = _arguments(given, prefix, names)
        taken.update({k: True for k in params if k not in given})
        if name == "info":
            wanted = arguments.pop("display_title", set())
            arguments = {"display_title": "displaytitle" in wanted}
        options[name] = arguments
    unused = set(params) - set(taken)
    if unused:
        raise ValueError(f"unused parameters {sorted(unused)}")
    return pageset.query_pages(cat, pages, prop, options) if prop else pages
