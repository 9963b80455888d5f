"""Flow records made up for the tests, written out one by one."""

from flowward.profiles import ATTACK_PROFILE, THREAT_LEGACY

LEGACY_HEADER = ",".join(THREAT_LEGACY.features)
LEGACY_ROWS = [
    "4,2,1730,2260,14,0.62,0.18,42,0.71,0.83",
    "17,0,395,12400,3,0.97,0.04,201,0.12,0.58",
    "61,3,8805,77,268,0.22,0.66,19,0.49,0.07",
]

ATTACK_HEADER = ",".join(ATTACK_PROFILE.features)
ATTACK_ROWS = [
    "443,62815,26,6165,1292,39,805,66,3419,777,283,275,4,751,68,1,1,0,1,318,209,67,24,0,0,2,7,0,2.25,108,6,14,178,10,106,32532,10138,20,93,26,264,23",
    "22,27564,44,3696,1124,40,1181,33,3393,236,221,23,4,880,7,1,1,1,0,209,374,30,35,1,0,1,2,0,1.5,252,9,214,72,4,99,42871,24102,32,129,57,223,9",
    "8443,44691,29,4959,1403,24,700,31,95,156,460,123,6,334,15,0,1,0,1,348,174,62,53,1,0,2,6,0,0.5,154,4,71,69,9,169,49927,18385,20,136,15,230,25",
    "21,24284,68,7164,928,40,963,68,433,594,569,196,2,221,34,0,0,0,0,298,128,31,51,0,0,0,1,0,0.5,287,12,154,15,9,27,38702,13785,32,10,9,251,2",
    "80,25087,10,1050,1350,59,1289,59,1781,595,224,100,8,290,65,1,1,1,1,151,244,58,46,0,0,0,2,1,1.75,100,12,45,182,7,175,2975,9815,32,10,51,237,33",
    "161,56148,87,507,919,58,1075,55,4126,562,63,223,6,110,70,1,1,0,0,349,95,56,24,0,0,0,0,1,1.25,129,7,41,185,7,237,30433,63888,32,167,22,220,3",
    "5432,17136,18,3177,1135,60,784,52,840,57,687,226,1,379,34,0,1,0,0,331,338,14,47,0,0,2,4,1,2.25,81,12,59,0,8,31,15029,26762,32,124,38,381,12",
    "993,85702,34,4722,998,37,1205,42,3745,654,126,210,7,879,41,1,0,0,1,156,255,60,56,1,0,1,3,1,2.25,27,4,97,107,4,105,35948,10821,32,82,46,317,9",
]
ATTACK_PORTS = [int(row.split(",")[0]) for row in ATTACK_ROWS]


def legacy(**changes) -> dict[str, float]:
    names = LEGACY_HEADER.split(",")
    return dict(zip(names, (float(v) for v in LEGACY_ROWS[0].split(",")))) | changes


def attack(**changes) -> dict[str, float]:
    row = dict(zip(ATTACK_PROFILE.columns, (float(v) for v in ATTACK_ROWS[0].split(","))))
    return row | changes


def write_csv(path, header: str, rows: list[str]) -> str:
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)
