"""Human-motion analytics on Spark. The names below come from their modules when they are first used."""

from importlib import import_module

_NAMES = {
    "sources.pivot": "read_documents trials poses auxiliary_points with_subject poses_from_array read_openpose read_trc read_c3d",
    "sources.settings": "load save merged",
    "operators.signals": "normalize register_step list_steps fill_gaps residual_analysis procrustes_align",
    "operators.pose": "compute_angles canonicalize_signs register_angle_method list_angle_methods extended_angles frontal_angles foot_progression match_sides correct_side_labels correct_pair_labels correct_ankle_projection correct_ankle_swaps center_on_torso align_skeleton mirror pixel_ratio confidence_filter estimate_feet angles_long to_long to_pose",
    "operators.events": "detect_events register_event_method list_event_methods consensus validate_events motion_mask trim_standstill",
    "operators.cycles": "segment curves summary ensemble mean_curves phase_by_frame dominant_direction flexion_positive",
    "operators.analysis": "spatiotemporal symmetry variability stride_variability clinical_markers flags instantaneous_cadence regularity harmonic_ratio harmonic_ratios scale step_lengths walking_speed single_support toe_clearance arm_swing speed_normalized patterns trendelenburg equinus",
    "operators.corrections": "correct_perspective correct_bias detrend_angles fit_landmark_bias remove_landmark_bias merge_landmark_bias smooth_landmark_bias",
    "operators.scores": "variable_scores profile_score deviation_index movement_profile",
    "operators.validation": "ranges adjusted spatiotemporal_ranges check_angles check_phases check_spatiotemporal check_cadence caveats model_accuracy",
    "operators.quality": "quality_score coherence treadmill other_people sagittal_alignment bounding_box person_extent visible_span detection_matrix",
    "operators.optical": "estimate_offset",
    "plans.pipeline": "run diagnose report",
    "exceptions": "InvalidData UnknownName",
}
_HOME = {name: module for module, names in _NAMES.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'kinelake' has no attribute {name!r}")
    return getattr(import_module(f"kinelake.{_HOME[name]}"), name)


def __dir__() -> list[str]:
    return __all__
