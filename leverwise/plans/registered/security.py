"""Access queries."""

from __future__ import annotations

from leverwise.operators import security as op

QUERIES = {
    "visible_attributes": (
        lambda t: op.visible_by_level(t),
        """
        select u.user_level, a.attr_id, a.attr_name
        from (select distinct sec_level as user_level from {user} where sec_level is not null) u
        join {attribute} a on u.user_level >= a.sec_level""",
    ),
    "visible_attributes_requested": (
        lambda t: op.visible_by_level(t, t.viewer),
        """
        select level as user_level, attr_id, attr_name
        from (select distinct sec_level as level from {user} where user_id in (select user_id from {viewer}))
        join {attribute} on sec_level <= level""",
    ),
    "visible_attributes_of_user": (
        lambda t: op.visible_attributes(t, 1),
        """
        select a.attr_id, a.attr_name from {attribute} a
        where a.sec_level <= (select sec_level from {user} where user_id = 1)""",
    ),
    "group_access_level": (
        lambda t: op.group_access_level(t, t.group_name, t.model.select("model_id")),
        """
        select m.model_id, max(g.security_level) as access_level
        from {model} m left join {access_group} g on g.model_group_id = m.model_group_id
         and g.ad_name in (select item from {group_name})
        group by m.model_id""",
    ),
    "is_super_group": (
        lambda t: op.is_super_group(t, t.group_name, t.model.select("model_id")),
        """
        select m.model_id, exists (select 1 from {super_user_group} g where g.model_group_id = m.model_group_id
               and g.ad_name in (select item from {group_name})) as is_super_user_group
        from {model} m""",
    ),
    "access_groups": (lambda t: op.access_groups(t), "select distinct ad_name from {access_group}"),
    "model_groups": (
        lambda t: op.model_groups(t, t.group_name),
        """
        with open_models as (select * from {model} where is_active and upload_complete),
        granted as (select model_group_id from {access_group} where ad_name in (select item from {group_name}))
        select model_group_id, name as model_group_name, model_id, filename, version as model_version, identifier,
               instances
        from open_models join (select model_group_id, name, identifier, instances from {model_group})
          using (model_group_id)
        where model_group_id in (from granted)""",
    ),
    "model_groups_admin": (
        lambda t: op.model_groups(t),
        """
        with shown as (
            select model_group_id, model_id, filename, version as model_version from {model} m
            where is_active and upload_complete
              and exists (select 1 from {access_group} a where a.model_group_id = m.model_group_id))
        select *, (select name from {model_group} g where g.model_group_id = shown.model_group_id) as model_group_name,
               (select identifier from {model_group} g where g.model_group_id = shown.model_group_id) as identifier,
               (select instances from {model_group} g where g.model_group_id = shown.model_group_id) as instances
        from shown""",
    ),
    "model_group_details": (
        lambda t: op.model_group_details(t, t.model_group.select("model_group_id")),
        """with grants as (
            select model_group_id, 'access' as grant_kind, access_group_id as grant_id, security_level, ad_name
            from {access_group}
            union all
            select model_group_id, 'super', super_user_group_id, null, ad_name from {super_user_group})
        select g.model_group_id, g.name as model_group_name, g.instances, g.identifier, m.model_id, m.filename,
               m.file_date, m.version, m.is_active, x.grant_kind, x.grant_id, x.security_level, x.ad_name
        from {model_group} g join {model} m on m.model_group_id = g.model_group_id and m.is_active
        join grants x on x.model_group_id = g.model_group_id
        where g.model_group_id in (select model_group_id from {access_group})
          and g.model_group_id in (select model_group_id from {super_user_group})""",
    ),
}
