"""Model, grant and user queries."""

from __future__ import annotations

from leverwise.operators import registry as op
from leverwise.plans.registered.common import NOW_SQL, now

REGISTER_SQL = """grouped as (
    select r.*, (select max(model_group_id) from {model_group}) + row_number() over (order by request_id)
             as model_group_id
    from {registration} r),
  placed as (
    select request_id, model_group_name, instances, identifier, filename, version, model_group_id,
           coalesce(model_id, greatest((select max(model_id) from {model}), (select max(model_id) from {registration}))
             + row_number() over (partition by model_id is null order by request_id)) as model_id
    from grouped)"""


def _register(t) -> op.Registration:
    return op.register_models(t, t.registration, t.registration_access, t.registration_super, now())


QUERIES = {
    "model_list": (
        lambda t: op.model_list(t),
        """
        select g.model_group_id, g.name as model_group_name, m.model_id, m.filename, m.file_date, m.version,
               m.upload_complete, g.identifier, g.instances
        from {model} m join {model_group} g on g.model_group_id = m.model_group_id""",
    ),
    "model_list_active": (
        lambda t: op.model_list(t, active_only=True),
        """
        select g.model_group_id, g.name as model_group_name, m.model_id, m.filename, m.file_date, m.version,
               m.upload_complete, g.identifier, g.instances
        from {model} m join {model_group} g on g.model_group_id = m.model_group_id where m.is_active""",
    ),
    "group_identifiers": (
        lambda t: op.group_identifiers(t, t.model.select("model_group_id")),
        """
        select model_group_id, identifier from {model_group}
        where model_group_id in (select model_group_id from {model})""",
    ),
    "register_models": (
        lambda t: _register(t).model,
        f"""with {REGISTER_SQL}
        select model_id, filename, {NOW_SQL} as file_date, true as is_active, version, model_group_id,
               cast(null as int) as last_rollback, cast(null as varchar) as rollback_filename,
               cast(null as timestamp_ntz) as rollback_file_date, cast(null as bigint) as top_of_tree_attr_id,
               false as upload_complete
        from placed""",
    ),
    "register_access_groups": (
        lambda t: _register(t).access_group,
        f"""with {REGISTER_SQL}
        select (select max(access_group_id) from {{access_group}})
                 + row_number() over (order by a.request_id, a.ad_name, a.security_level) as access_group_id,
               a.security_level, a.ad_name, p.model_group_id
        from {{registration_access}} a join placed p on p.request_id = a.request_id""",
    ),
    "new_versions": (
        lambda t: op.new_versions(t, t.version_update, now()),
        f"""
        select m.model_id, u.filename, {NOW_SQL} as file_date, true as is_active, u.version, m.model_group_id,
               u.version - 1 as last_rollback, m.filename as rollback_filename, m.file_date as rollback_file_date,
               m.top_of_tree_attr_id, m.upload_complete
        from {{model}} m join {{version_update}} u on u.model_id = m.model_id""",
    ),
    "new_versions_by_group": (
        lambda t: op.new_versions(t, t.group_version_update, now(), key="model_group_id"),
        f"""
        select m.model_id, u.filename, {NOW_SQL} as file_date, true as is_active, u.version, m.model_group_id,
               u.version - 1 as last_rollback, m.filename as rollback_filename, m.file_date as rollback_file_date,
               m.top_of_tree_attr_id, m.upload_complete
        from {{model}} m join {{group_version_update}} u on u.model_group_id = m.model_group_id""",
    ),
    "new_versions_synced": (
        lambda t: op.new_versions(t, t.version_update, now(), keep_rollback=False),
        f"""
        select m.model_id, u.filename, {NOW_SQL} as file_date, true as is_active, u.version, m.model_group_id,
               m.last_rollback, m.rollback_filename, m.rollback_file_date, m.top_of_tree_attr_id, m.upload_complete
        from {{model}} m join {{version_update}} u on u.model_id = m.model_id""",
    ),
    "rollback_versions": (
        lambda t: op.rollback_versions(t, t.model.where("rollback_filename is not null")),
        """
        select model_id, coalesce(rollback_filename, filename) as filename,
               case when rollback_filename is null then file_date else rollback_file_date end as file_date, is_active,
               case when rollback_filename is null then version else version - 1 end as version, model_group_id,
               last_rollback, cast(null as varchar) as rollback_filename,
               cast(null as timestamp_ntz) as rollback_file_date, top_of_tree_attr_id, upload_complete
        from {model}""",
    ),
    "previous_versions": (
        lambda t: op.previous_versions(t, t.model_group.select("model_group_id")),
        """
        select model_group_id, model_id, last_rollback as model_rollback_version,
               rollback_filename as model_rollback_filename,
               strftime(rollback_file_date, '%Y-%m-%d %H:%M:%S') as model_rollback_file_date
        from {model} where version > last_rollback""",
    ),
    "reconcile_access_groups": (
        lambda t: op.reconcile_access_groups(t, t.access_batch, t.scope),
        """
        select g.access_group_id, coalesce(b.security_level, g.security_level) as security_level, g.ad_name,
               g.model_group_id,
               case when b.access_group_id is not null then 'U'
                    when g.model_group_id in (select model_group_id from {scope}) then 'D' else 'keep' end as action
        from {access_group} g left join (
            select * from {access_batch} where model_group_id in (select model_group_id from {scope})) b
          on b.access_group_id = g.access_group_id and b.model_group_id = g.model_group_id
        union all
        select (select max(access_group_id) from {access_group})
                 + row_number() over (order by b.model_group_id, b.access_group_id), b.security_level, b.ad_name,
               b.model_group_id, 'I'
        from {access_batch} b
        where b.model_group_id in (select model_group_id from {scope}) and not exists (
            select 1 from {access_group} g
            where g.access_group_id = b.access_group_id and g.model_group_id = b.model_group_id)""",
    ),
    "reconcile_super_groups": (
        lambda t: op.reconcile_super_groups(t, t.super_batch, t.scope),
        """
        select g.super_user_group_id, coalesce(b.ad_name, g.ad_name) as ad_name, g.model_group_id,
               case when b.super_user_group_id is not null then 'U'
                    when g.model_group_id in (select model_group_id from {scope}) then 'D' else 'keep' end as action
        from {super_user_group} g left join (
            select * from {super_batch} where model_group_id in (select model_group_id from {scope})) b
          on b.super_user_group_id = g.super_user_group_id and b.model_group_id = g.model_group_id
        union all
        select (select max(super_user_group_id) from {super_user_group})
                 + row_number() over (order by b.model_group_id, b.super_user_group_id), b.ad_name,
               b.model_group_id, 'I'
        from {super_batch} b
        where b.model_group_id in (select model_group_id from {scope}) and not exists (
            select 1 from {super_user_group} g
            where g.super_user_group_id = b.super_user_group_id and g.model_group_id = b.model_group_id)""",
    ),
    "upsert_users": (
        lambda t: op.upsert_users(t, t.user_batch),
        """
        select coalesce(u.user_id, b.user_id) as user_id, coalesce(u.login, b.login) as login,
               case when b.user_id is null then u.sec_level else b.sec_level end as sec_level,
               case when u.user_id is null then b.ad_name else u.ad_name end as ad_name,
               coalesce(b.is_power_user, u.is_power_user) as is_power_user,
               coalesce(b.is_admin_user, u.is_admin_user) as is_admin_user
        from {user} u full outer join {user_batch} b on b.user_id = u.user_id""",
    ),
    "add_users": (
        lambda t: op.add_users(t, t.user_batch.where("login <> 'ignored'").drop("user_id")),
        """
        select (select max(user_id) from {user}) + row_number() over (order by login) as user_id, login, sec_level, ad_name,
               is_power_user, is_admin_user
        from {user_batch} where login <> 'ignored'""",
    ),
    "set_user_roles": (
        lambda t: op.set_user_roles(t, t.user_batch),
        """
        select u.user_id, u.login, case when b.user_id is null then u.sec_level else b.sec_level end as sec_level,
               u.ad_name, coalesce(b.is_power_user, u.is_power_user) as is_power_user,
               coalesce(b.is_admin_user, u.is_admin_user) as is_admin_user
        from {user} u left join {user_batch} b on b.user_id = u.user_id""",
    ),
    "flag_ready": (
        lambda t: op.flag_ready(t, t.model_import).select("model_id", "upload_complete"),
        """
        select model_id, upload_complete or model_id in (select model_id from {model_import}) as upload_complete
        from {model}""",
    ),
}
