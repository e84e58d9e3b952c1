"""Table schemas of the engine, declared once, and the fixed names of landmarks."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _I, _B = T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


POINT = _struct(x=_D, y=_D, visibility=_D)
META = _struct(source=_S, video_path=_S, fps=_D, width=_I, height=_I, n_frames=_I, duration_s=_D)
EXTRACTION = _struct(model=_S, was_flipped=_B, treadmill=_B)
SUBJECT = _struct(age=_I, sex=_S, height_m=_D, weight_kg=_D, pathology=_S, notes=_S)
FRAME = _struct(
    frame_idx=_I, time_s=_D, confidence=_D, landmarks=T.MapType(_S, POINT), landmark_depths=T.MapType(_S, _D), landmark_body_parts=T.MapType(_S, _S),
    goliath308=T.ArrayType(T.ArrayType(_D)), wholebody133=T.ArrayType(T.ArrayType(_D)),
)
DOCUMENT = _struct(trial_id=_S, meta=META, extraction=EXTRACTION, subject=SUBJECT, frames=T.ArrayType(FRAME))
POSE = _struct(trial_id=_S, frame_idx=_I, pos=_I, time_s=_D, confidence=_D, landmarks=T.MapType(_S, POINT), landmark_depths=T.MapType(_S, _D))
TRIALS = _struct(trial_id=_S, meta=META, extraction=EXTRACTION, subject=SUBJECT)
LANDMARKS = _struct(trial_id=_S, frame_idx=_I, pos=_I, time_s=_D, name=_S, x=_D, y=_D, visibility=_D, confidence=_D)
EVENTS = _struct(trial_id=_S, side=_S, kind=_S, frame=_I, time=_D, confidence=_D, method=_S)
CYCLES = _struct(trial_id=_S, cycle_id=_I, side=_S, start_frame=_I, end_frame=_I, toe_off_frame=_I, duration=_D, stance_pct=_D, swing_pct=_D)
CURVES = _struct(trial_id=_S, cycle_id=_I, side=_S, joint=_S, p=_I, value=_D)
MARKERS = _struct(trial_id=_S, frame_idx=_I, name=_S, X=_D, Y=_D, Z=_D)

JOINTS = ("hip", "knee", "ankle", "trunk", "pelvis")

# Landmark names by format, in the order of their indices.
MEDIAPIPE_33 = (
    "NOSE LEFT_EYE_INNER LEFT_EYE LEFT_EYE_OUTER RIGHT_EYE_INNER RIGHT_EYE RIGHT_EYE_OUTER LEFT_EAR RIGHT_EAR MOUTH_LEFT MOUTH_RIGHT "
    "LEFT_SHOULDER RIGHT_SHOULDER LEFT_ELBOW RIGHT_ELBOW LEFT_WRIST RIGHT_WRIST LEFT_PINKY RIGHT_PINKY LEFT_INDEX RIGHT_INDEX LEFT_THUMB RIGHT_THUMB "
    "LEFT_HIP RIGHT_HIP LEFT_KNEE RIGHT_KNEE LEFT_ANKLE RIGHT_ANKLE LEFT_HEEL RIGHT_HEEL LEFT_FOOT_INDEX RIGHT_FOOT_INDEX"
).split()
COCO_17 = (
    "NOSE LEFT_EYE RIGHT_EYE LEFT_EAR RIGHT_EAR LEFT_SHOULDER RIGHT_SHOULDER LEFT_ELBOW RIGHT_ELBOW LEFT_WRIST RIGHT_WRIST "
    "LEFT_HIP RIGHT_HIP LEFT_KNEE RIGHT_KNEE LEFT_ANKLE RIGHT_ANKLE"
).split()
#: None is a keypoint computed from others (neck, hip and head middles) or one without a counterpart.
BODY_25 = (
    ["NOSE", None, "RIGHT_SHOULDER", "RIGHT_ELBOW", "RIGHT_WRIST", "LEFT_SHOULDER", "LEFT_ELBOW", "LEFT_WRIST", None, "RIGHT_HIP", "RIGHT_KNEE", "RIGHT_ANKLE"]
    + ["LEFT_HIP", "LEFT_KNEE", "LEFT_ANKLE", "RIGHT_EYE", "LEFT_EYE", "RIGHT_EAR", "LEFT_EAR", "LEFT_FOOT_INDEX", None, "LEFT_HEEL", "RIGHT_FOOT_INDEX", None, "RIGHT_HEEL"]
)
HALPE_26 = [*COCO_17, None, None, None, "LEFT_FOOT_INDEX", "RIGHT_FOOT_INDEX", None, None, "LEFT_HEEL", "RIGHT_HEEL"]
#: Middles by format: index, and the landmarks whose mean it is.
MIDDLES = {"BODY_25": {1: ("LEFT_SHOULDER", "RIGHT_SHOULDER"), 8: ("LEFT_HIP", "RIGHT_HIP")}, "HALPE_26": {17: ("LEFT_EAR", "RIGHT_EAR"), 18: ("LEFT_SHOULDER", "RIGHT_SHOULDER"), 19: ("LEFT_HIP", "RIGHT_HIP")}, "COCO": {}}
FORMATS = {"COCO": COCO_17, "BODY_25": BODY_25, "HALPE_26": HALPE_26}
# Body segments as proximal landmark, distal landmark, name.
SEGMENTS = [
    ("LEFT_HIP", "LEFT_KNEE", "femur_L"), ("RIGHT_HIP", "RIGHT_KNEE", "femur_R"), ("LEFT_KNEE", "LEFT_ANKLE", "tibia_L"), ("RIGHT_KNEE", "RIGHT_ANKLE", "tibia_R"),
    ("LEFT_SHOULDER", "LEFT_ELBOW", "upper_arm_L"), ("RIGHT_SHOULDER", "RIGHT_ELBOW", "upper_arm_R"), ("LEFT_ELBOW", "LEFT_WRIST", "forearm_L"), ("RIGHT_ELBOW", "RIGHT_WRIST", "forearm_R"),
    ("LEFT_SHOULDER", "LEFT_HIP", "trunk_L"), ("RIGHT_SHOULDER", "RIGHT_HIP", "trunk_R"),
]
# Mass as a share of the body's, and centre of mass as a share of the length from the proximal end.
SEGMENT_MASS = {"head": (0.081, 0.5), "trunk": (0.497, 0.5), "upper_arm": (0.028, 0.436), "forearm": (0.022, 0.43), "femur": (0.1, 0.433), "tibia": (0.047, 0.433)}


def mirrored(name: str) -> str:
    """The same landmark of the other side."""
    if "LEFT" in name:
        return name.replace("LEFT", "RIGHT")
    return name.replace("RIGHT", "LEFT")
