"""Names that frameworks call, read or register."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...config import Config
from ...functions import columns as C
from . import base as B

# Decorators, methods, bases and directories by framework.
FASTAPI_ROUTES = ("get", "post", "put", "patch", "delete", "options", "head", "trace", "api_route", "websocket", "websocket_route")
FASTAPI_HOOKS = ("on_event", "exception_handler", "middleware")
FLASK_VIEW_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "dispatch_request")
FLASK_DECORATORS = (
    "route", "get", "post", "put", "patch", "delete", "errorhandler", "before_request", "after_request", "teardown_request", "teardown_appcontext",
    "before_app_request", "after_app_request", "context_processor", "app_context_processor", "template_filter", "app_template_filter", "template_global",
    "app_template_global", "template_test", "url_value_preprocessor", "url_defaults", "shell_context_processor", "record", "record_once",
)
CELERY_METHODS = ("run", "before_start", "on_success", "on_failure", "on_retry", "after_return")
AIRFLOW_DECORATORS = ("dag", "task", "task_group", "setup", "teardown")
AIRFLOW_METHODS = ("execute", "poke", "pre_execute", "post_execute", "on_kill")
DJANGO_HOOKS = (
    "save", "delete", "clean", "clean_fields", "full_clean", "get_absolute_url", "natural_key",
    "is_staff", "is_active", "is_superuser", "is_anonymous", "is_authenticated", "has_perm", "has_perms", "has_module_perms", "get_full_name",
    "get_short_name", "get_username", "get_session_auth_hash", "set_password", "check_password", "set_unusable_password", "has_usable_password",
    "save_model", "save_formset", "save_related",
    "get_queryset", "get_object", "get_context_data", "get_form", "get_form_class", "get_form_kwargs", "get_success_url", "get_template_names",
    "get_urls", "get_readonly_fields", "get_list_display", "get_fieldsets", "get_search_results", "form_valid", "form_invalid", "dispatch", "setup",
    "get", "post", "put", "patch", "delete", "head", "options", "trace",
    "list", "create", "retrieve", "update", "partial_update", "destroy", "perform_create", "perform_update", "perform_destroy", "get_serializer",
    "get_serializer_class", "get_serializer_context", "get_permissions", "get_authenticators", "get_throttles", "get_paginated_response",
    "paginate_queryset", "filter_queryset", "validate", "to_representation", "to_internal_value", "has_permission", "has_object_permission",
    "handle", "add_arguments", "process_request", "process_response", "process_view", "process_exception", "process_template_response",
    "ready", "create_user", "create_superuser", "get_by_natural_key",
)
DJANGO_BASES = ("Model", "Form", "ModelForm", "ModelAdmin", "StackedInline", "TabularInline", "View", "Serializer", "ModelSerializer", "ViewSet", "ModelViewSet", "AppConfig")
DJANGO_LIBRARY = ("tag", "filter", "simple_tag", "simple_block_tag", "inclusion_tag")
GRAPHENE_HOOKS = ("mutate", "mutate_and_get_payload", "perform_mutation", "resolve_type", "resolve_id", "get_node", "get_queryset", "is_type_of", "subscribe")
GRAPHENE_PACKAGES = ("graphene", "graphql", "graphene_django", "strawberry")
GRAPHENE_BASES = ("ObjectType", "Mutation", "InputObjectType", "Interface", "Subscription", "Enum")
TEXTUAL_BASES = ("MessagePump", "DOMNode", "Widget", "App", "Screen", "ScrollView", "ModalScreen")
HOMEASSISTANT_HOOKS = (
    "setup", "async_setup", "async_setup_entry", "async_unload_entry", "async_migrate_entry", "async_remove_entry", "async_remove_config_entry_device",
    "setup_platform", "async_setup_platform", "async_setup_scanner", "async_get_config_entry_diagnostics", "async_get_device_diagnostics",
    "async_get_triggers", "async_get_conditions", "async_get_actions", "async_attach_trigger", "async_validate_trigger_config",
    "async_validate_condition_config", "async_validate_action_config", "async_call_action_from_config", "async_condition_from_config",
    "async_get_trigger_capabilities", "async_get_condition_capabilities", "async_get_action_capabilities", "async_get_service",
    "async_get_backup_agents", "async_register_backup_agents_listener", "async_setup_intents", "async_get_options_flow", "async_get_media_source",
    "async_browse_media", "async_describe_events", "async_describe_on_off_states", "async_get_significant_states", "async_setup_services",
)
HOMEASSISTANT_CONSTANTS = (
    "DOMAIN", "PLATFORMS", "CONFIG_SCHEMA", "PLATFORM_SCHEMA", "PLATFORM_SCHEMA_BASE", "TRIGGER_SCHEMA", "CONDITION_SCHEMA", "ACTION_SCHEMA",
    "PARALLEL_UPDATES", "SCAN_INTERVAL", "ENTITY_ID_FORMAT", "SERVICE_SCHEMA", "DEFAULT_NAME",
)
ANSIBLE_KINDS = (
    "action", "become", "cache", "callback", "cliconf", "connection", "doc_fragments", "filter", "httpapi", "inventory", "lookup", "module_utils",
    "modules", "netconf", "shell", "strategy", "terminal", "test", "vars",
)
ALEMBIC_NAMES = ("revision", "down_revision", "branch_labels", "depends_on", "upgrade", "downgrade")
SQLALCHEMY_BASES = ("Base", "DeclarativeBase", "Model")
SQLALCHEMY_METHODS = ("validates", "hybrid_property", "declared_attr", "reconstructor")
PYDANTIC_BASES = ("BaseModel", "BaseSettings", "SQLModel")
PYDANTIC_DECORATORS = ("field_validator", "model_validator", "validator", "root_validator", "field_serializer", "model_serializer", "computed_field")


def fastapi(config: Config) -> list[B.Rule]:
    where = ("fastapi", "starlette")
    return [("route handler", B.decorated(FASTAPI_ROUTES, where, receiver=True)), ("application hook", B.decorated(FASTAPI_HOOKS, where, receiver=True))]


def flask(config: Config) -> list[B.Rule]:
    return [("registered with an app or blueprint", B.decorated(FLASK_DECORATORS, ("flask",), receiver=True)), ("view method", B.is_method & B.name.isin(*FLASK_VIEW_METHODS))]


def click(config: Config) -> list[B.Rule]:
    where = ("click", "typer")
    return [("command", B.decorated(("command", "group", "callback"), where, receiver=True) | B.decorated(("command", "group"), where))]


def celery(config: Config) -> list[B.Rule]:
    where = ("celery",)
    return [
        ("task", B.decorated(("task", "periodic_task", "shared_task"), where, receiver=True) | B.decorated(("shared_task", "periodic_task"), where)),
        ("connected to a signal", B.decorated(("connect",), where, receiver=True)),
        ("hook of a task", B.is_method & B.name.isin(*CELERY_METHODS)),
    ]


def airflow(config: Config) -> list[B.Rule]:
    first = F.exists("decorators", lambda d: F.split(d["name"], r"\.")[0].isin(*AIRFLOW_DECORATORS))
    return [
        ("flow or task", first | B.decorated(AIRFLOW_DECORATORS, ("airflow",))),
        ("object of a flow file", C.under(B.path, "dags") & B.kind.isin("variable", "constant")),
        ("hook of an operator", B.is_method & B.name.isin(*AIRFLOW_METHODS)),
    ]


def django(config: Config) -> list[B.Rule]:
    model_like = lambda b: ~b.isin("BaseModel", "SQLModel") & (b.endswith("Model") | b.startswith("Abstract"))
    return [
        ("migration", B.is_class & (F.coalesce(B.parent == "migrations", F.lit(False)) & (B.name == "Migration") | B.ancestor_in("django.db.migrations"))),
        ("management command", (B.parent == "commands") & C.under(B.path, "management") & B.is_class & (B.name == "Command")),
        ("app settings class", (B.file_name == "apps.py") & B.is_class & B.name.endswith("Config")),
        ("model", B.is_class & B.ancestor_in("django.db.models")),
        ("model by its base's name", ((B.file_name == "models.py") | F.coalesce(B.parent == "models", F.lit(False))) & B.is_class & ~F.col("complete") & B.any_base(F.col("bases"), model_like)),
        ("setting", (B.file_name.startswith("settings") | F.coalesce(F.col("role") == "django-settings", F.lit(False))) & B.kind.isin("constant", "variable")),
        ("URL configuration", (B.name == "urlpatterns") & B.top_level),
        ("server entry point", B.file_name.isin("wsgi.py", "asgi.py") & (B.name == "application")),
        ("hook method", B.is_method & (B.name.isin(*DJANGO_HOOKS) | B.name.rlike("^(?:validate_|clean_|formfield_for_)") | B.name.startswith("has_") & B.name.endswith("_permission"))),
        ("registered", B.decorated(("register",), ("django",))),
        ("tag or filter of templates", B.decorated(DJANGO_LIBRARY, ("django",), receiver=True)),
        ("signal receiver", B.decorated(("receiver",), ("django",))),
        ("attribute of a framework class", B.attribute_of(("django",), DJANGO_BASES) | B.attribute_of(("rest_framework",), DJANGO_BASES)),
        ("test case", ((B.file_name == "tests.py") | C.under(B.path, "tests")) & B.is_class & B.name.rlike("^Test|Tests?$")),
    ]


def graphene(config: Config) -> list[B.Rule]:
    like = lambda b: b.isin(*GRAPHENE_BASES) | b.endswith("ObjectType") | b.endswith("Mutation")
    schema = B.ancestor_in(*GRAPHENE_PACKAGES) | ~F.col("complete") & F.exists("ancestors", lambda a: like(C.last_segment(a)))
    hook = B.name.startswith("resolve_") | B.name.endswith("__resolve_reference") | B.name.endswith("__resolve_references") | B.name.isin(*GRAPHENE_HOOKS)
    return [("field of a schema type", B.is_attribute & schema), ("hook of a schema type", B.is_method & hook & schema)]


def textual(config: Config) -> list[B.Rule]:
    pump = B.ancestor_in("textual.message_pump") | ~F.col("complete") & F.exists("ancestors", lambda a: C.last_segment(a).isin(*TEXTUAL_BASES))
    return [("message handler", B.is_method & B.name.rlike("^_?on_") & pump)]


def homeassistant(config: Config) -> list[B.Rule]:
    here = F.coalesce(F.col("role") == "integration", F.lit(False))
    return [
        ("setup hook", here & B.top_level & B.name.isin(*HOMEASSISTANT_HOOKS)),
        ("constant of an integration", here & B.top_level & B.name.isin(*HOMEASSISTANT_CONSTANTS)),
        ("step of a flow", here & B.is_method & B.name.startswith("async_step_")),
        ("flow handler", here & B.is_class & (B.file_name == "config_flow.py")),
    ]


def ansible(config: Config) -> list[B.Rule]:
    return [("found by the plugin loader", B.top_level & B.path.rlike("(?:^|/)(?:plugins/(?:" + "|".join(ANSIBLE_KINDS) + ")|ansible/modules)(?:/|$)"))]


def alembic(config: Config) -> list[B.Rule]:
    return [
        ("attribute of a migration script", (B.parent == "versions") & B.name.isin(*ALEMBIC_NAMES)),
        ("migration environment", (B.file_name == "env.py") & C.under(B.path, "alembic")),
        ("migration script", (F.col("role") == "migration-script") & B.top_level),
    ]


def sqlalchemy(config: Config) -> list[B.Rule]:
    where = ("sqlalchemy",)
    owner = F.col("owner")
    maps = owner.isNotNull() & F.coalesce(F.array_contains(owner["class_keywords"], "table"), F.lit(False))
    return [
        ("table model", B.is_class & F.coalesce(F.array_contains("class_keywords", "table"), F.lit(False))),
        ("declarative model", B.is_class & (B.descends(where, SQLALCHEMY_BASES) | B.descends(("flask_sqlalchemy",), SQLALCHEMY_BASES))),
        ("event listener", B.decorated(("listens_for",), where)),
        ("mapped attribute or validator", B.decorated(SQLALCHEMY_METHODS, where)),
        ("column of a model", B.is_attribute & (maps | B.attribute_of(where, SQLALCHEMY_BASES) | B.attribute_of(("flask_sqlalchemy",), SQLALCHEMY_BASES))),
    ]


def pydantic(config: Config) -> list[B.Rule]:
    field = F.lit(False)
    for package in ("pydantic", "pydantic_settings", "sqlmodel"):
        field |= B.attribute_of((package,), PYDANTIC_BASES)
    return [("validator or serializer", B.decorated(PYDANTIC_DECORATORS, ("pydantic",))), ("field of a model", field)]
