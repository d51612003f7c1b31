from shelfsight.functions.columns import (  # noqa: F401
    as_double,
    as_int,
    day_of,
    flag_text,
    id_of,
    iso_week,
    mat_id,
    name_of,
    ratio,
    round4,
    snap_to_zero,
)
