"""Declared schemas of the wiki tables and the constants stored in them.

Timestamps are ``timestamp_ntz`` in UTC. "Never" is the largest timestamp, so
that ``expiry > now`` needs no special case; see ``INFINITY``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# fixed values: bits of the *_deleted columns
DELETED_TEXT = 1
DELETED_ACTION = 1
DELETED_COMMENT = 2
DELETED_USER = 4
DELETED_RESTRICTED = 8

INFINITY = dt.datetime(9999, 12, 31, 23, 59, 59, 999999)
NEG_INFINITY = dt.datetime(1, 1, 1)

_TYPES = {
    "id": T.LongType(), "int": T.IntegerType(), "str": T.StringType(),
    "bool": T.BooleanType(), "ts": T.TimestampNTZType(), "float": T.DoubleType(),
    "strs": T.ArrayType(T.StringType()), "span": T.DayTimeIntervalType(),
}


def _table(spec: str) -> T.StructType:
    fields = [item.split(":") for item in spec.split()]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {
    "namespace": _table(
        "ns_id:int ns_case:str ns_content:bool ns_subpages:bool ns_nonincludable:bool "
        "ns_defaultcontentmodel:str ns_protection:str"
    ),
    "namespace_name": _table("nsn_id:int nsn_name:str"),
    "namespace_starname": _table("nss_id:int nss_name:str"),
    "namespace_canonical": _table("nsc_id:int nsc_name:str"),
    "ws_sync": _table("wss_key:str wss_timestamp:ts"),
    "interwiki": _table("iw_prefix:str iw_url:str iw_api:str iw_local:bool iw_trans:bool"),
    "tag": _table(
        "tag_id:id tag_name:str tag_displayname:str tag_description:str tag_defined:bool "
        "tag_active:bool tag_source:strs"
    ),
    "recentchanges": _table(
        "rc_id:id rc_timestamp:ts rc_user:id rc_user_text:str rc_namespace:int rc_title:str "
        "rc_comment:str rc_minor:bool rc_bot:bool rc_new:bool rc_cur_id:id rc_this_oldid:id "
        "rc_last_oldid:id rc_type:str rc_source:str rc_patrolled:bool rc_old_len:id "
        "rc_new_len:id rc_deleted:int rc_logid:id rc_log_type:str rc_log_action:str rc_params:str"
    ),
    "logging": _table(
        "log_id:id log_type:str log_action:str log_timestamp:ts log_user:id log_user_text:str "
        "log_namespace:int log_title:str log_page:id log_comment:str log_params:str log_deleted:int"
    ),
    "tagged_recentchange": _table("tgrc_tag_id:id tgrc_rc_id:id"),
    "tagged_logevent": _table("tgle_tag_id:id tgle_log_id:id"),
    "users": _table("user_id:id user_name:str user_registration:ts user_editcount:id"),
    "user_groups": _table("ug_user:id ug_group:str ug_expiry:ts"),
    "ipblocks": _table(
        "ipb_id:id ipb_address:str ipb_user:id ipb_by:id ipb_by_text:str ipb_reason:str "
        "ipb_timestamp:ts ipb_auto:bool ipb_anon_only:bool ipb_create_account:bool "
        "ipb_enable_autoblock:bool ipb_expiry:ts ipb_range_start:str ipb_range_end:str "
        "ipb_deleted:bool ipb_block_email:bool ipb_allow_usertalk:bool ipb_parent_block_id:id"
    ),
    "archive": _table(
        "ar_id:id ar_namespace:int ar_title:str ar_rev_id:id ar_page_id:id ar_text_id:id "
        "ar_comment:str ar_user:id ar_user_text:str ar_timestamp:ts ar_minor_edit:bool "
        "ar_deleted:int ar_len:id ar_parent_id:id ar_sha1:str ar_content_model:str "
        "ar_content_format:str"
    ),
    "revision": _table(
        "rev_id:id rev_page:id rev_text_id:id rev_comment:str rev_user:id rev_user_text:str "
        "rev_timestamp:ts rev_minor_edit:bool rev_deleted:int rev_len:id rev_parent_id:id "
        "rev_sha1:str rev_content_model:str rev_content_format:str"
    ),
    "texts": _table("old_id:id old_text:str"),
    "tagged_revision": _table("tgrev_tag_id:id tgrev_rev_id:id"),
    "tagged_archived_revision": _table("tgar_tag_id:id tgar_rev_id:id"),
    "page": _table(
        "page_id:id page_namespace:int page_title:str page_is_redirect:bool page_is_new:bool "
        "page_touched:ts page_links_updated:ts page_latest:id page_len:id "
        "page_content_model:str page_lang:str"
    ),
    "page_props": _table("pp_page:id pp_propname:str pp_value:str pp_sortkey:float"),
    "page_restrictions": _table(
        "pr_id:id pr_page:id pr_type:str pr_level:str pr_cascade:bool pr_user:id pr_expiry:ts"
    ),
    "protected_titles": _table("pt_namespace:int pt_title:str pt_level:str pt_expiry:ts"),
    "pagelinks": _table("pl_from:id pl_namespace:int pl_title:str"),
    "templatelinks": _table("tl_from:id tl_namespace:int tl_title:str"),
    "imagelinks": _table("il_from:id il_to:str"),
    "categorylinks": _table(
        "cl_from:id cl_to:str cl_sortkey:str cl_sortkey_prefix:str cl_collation:str cl_type:str"
    ),
    "langlinks": _table("ll_from:id ll_lang:str ll_title:str"),
    "iwlinks": _table("iwl_from:id iwl_prefix:str iwl_title:str"),
    "externallinks": _table("el_from:id el_to:str"),
    "redirect": _table("rd_from:id rd_namespace:int rd_title:str rd_interwiki:str rd_fragment:str"),
    "section": _table("sec_page:id sec_number:int sec_level:int sec_title:str sec_anchor:str"),
    "ws_parser_cache_sync": _table("wspc_page_id:id wspc_rev_id:id"),
    "ws_domain": _table("name:str last_check:ts resolved:bool server:str ssl_error:str"),
    "ws_url_check": _table(
        "domain_name:str url:str last_check:ts check_duration:span http_status:int "
        "text_status:str result:str"
    ),
}
