from shelfsight.plans.execution import (  # noqa: F401
    cluster_settings,
    ensure_checkpoint_dir,
    local_session,
    materialize,
    session_defaults,
)
