"""The texts that are shown for reasons, modes and places."""

UNRANKED = {
    "missing_start_coverage": "Not ranked — telemetry did not cover the start line.",
    "missing_telemetry": "Unavailable for the current course layout — raw telemetry is missing.",
    "replay_incomplete": "Unavailable for the current course layout.",
    "not_valid": "Unranked — the course match was not reliable enough.",
    "not_completed": "This attempt is not an official run.",
}
UNAVAILABLE_WAITING = {
    "missing_comparison_target": "No PB comparison run is available.",
    "current_not_eligible": "Waiting comparison is unavailable for this course layout.",
    "reference_not_eligible": "Waiting comparison is unavailable for this course layout.",
    "current_movement_not_displayable": "Waiting comparison needs trustworthy movement data on both runs.",
    "reference_movement_not_displayable": "Waiting comparison needs trustworthy movement data on both runs.",
}
UNAVAILABLE_GHOST = {
    "missing_comparison_target": "No PB comparison run is available.",
    "current_not_eligible": "Ghost comparison is unavailable for this course layout.",
    "reference_not_eligible": "Ghost comparison is unavailable for this course layout.",
    "current_polyline_unavailable": "Ghost comparison needs trustworthy route-progress coverage on both runs.",
    "reference_polyline_unavailable": "Ghost comparison needs trustworthy route-progress coverage on both runs.",
}
MODES = {"scooter": "Scooter", "bike": "Bike", "run": "Run", "walk": "Walk"}
MODE_ICONS = {"scooter": "🛴", "bike": "🚲", "run": "🏃", "walk": "🚶"}
ENDPOINTS = {"start": "Start", "finish": "Finish"}
LAYOUT = {
    "start_radius": "Auto-start radius must be between 8 and 250 m.",
    "finish_radius": "Auto-finish radius must be between 8 and 250 m.",
    "checkpoint_name": "Every checkpoint needs a name.",
    "markers_too_close": "Course markers must stay at least 10 m apart along the route.",
}
UNSAVEABLE = {
    "too_little_movement": "This recording is too short or low-quality to save as a route.",
    "start_and_finish_too_close": "Start and finish are too close to save as a route.",
}
ARMING = {
    "missing_route": "This route is no longer available.",
    "bad_course": "This course cannot be armed.",
    "recording": "Finish or cancel the current recording before arming a run.",
    "pending_route": "Save or discard the unsaved route recording first.",
    "open_attempt": "An attempt is already armed or active.",
}
TAP_TOO_FAR = "Tap closer to the route."
