"""Fixed values of the trip analytics, in metres, milliseconds and metres a second."""

EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_320.0

# Course matching.
CORRIDOR_M, MAX_ACCURACY_M = 35.0, 45.0
AHEAD_M, BEHIND_M = 90.0, 25.0
FIRST_AHEAD_M, FIRST_BEHIND_M = 70.0, 50.0
PROGRESS_COST, BACKWARD_COST_M = 0.3, 8.0
TIE_M, SNAP_M = 0.5, 30.0

# Timing.
DEPARTURE_M, DEPARTURE_MS, DEPARTURE_SAMPLES = 18.0, 5_000, 4
START_NOISE_M, PRE_START_M, HYSTERESIS_M = 5.0, 3.0, 4.0
ABANDON_MS, DEVIATION_MS = 60_000.0, 25_000.0
MARKER_GAP_M, RADIUS_RANGE_M = 10.0, (8.0, 250.0)

# Route derivation.
ROUTE_ACCURACY_M, STEP_M, MOVING_MPS = 25.0, 6.0, 0.8
SUSTAINED, LEAST_POINTS, SEPARATION_M, ZONE_RADIUS_M = 3, 3, 10.0, 30.0

# Movement.
WALK_MPS, WAIT_MPS = 0.55, 0.3
USABLE_ACCURACY_M, DENSE_MS = 25.0, 8_000.0
GAP_MS, GAP_ACCURACY_M, GAP_MOVE_M, GAP_PROGRESS_M = 120_000.0, 25.0, 15.0, 15.0
WINDOW_MS, FORWARD_M, SINGLE_MOVE_M, FORWARD_INTERVALS = 4_000, 0.8, 6.0, 2
PLAUSIBLE_MPS, COVERAGE, TOTAL_TOLERANCE_MS = 25.0, 0.75, 1.0

# Waits and their comparison.
MERGE_GAP_MS, MERGE_PROGRESS_M, VISIBLE_MS, TAP_M = 5_000.0, 15.0, 3_000.0, 40.0
CLUSTER_M, SHOWN_MS, SHOWN_ROWS = 40.0, 3_000.0, 5

# Ghost comparison and freshness.
GHOST_M, NEAR_M, STALE_MS = 0.05, 5.0, 120_000

# What a map or a preview shows: padding of the box, the box of nothing (west, south, east, north), and sizes of zones in percent.
PAD_SHARE, LEAST_PAD = 0.15, 0.001
DEFAULT_BOX = (34.75, 32.05, 34.82, 32.12)
LEAST_SPAN, DIAMETER_RANGE = 0.0001, (4.0, 80.0)
