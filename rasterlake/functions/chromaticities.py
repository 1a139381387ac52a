"""Colour primaries by token."""

# --- fixed values: chromaticities (x, y) of R, G, B and white ---------------
D65 = (0.3127, 0.3290)
ILLUMINANT_C = (0.3101, 0.3162)
DCI_WHITE = (0.314, 0.351)
PRIMARIES = {
    "bt709": ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), D65),
    "bt2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), D65),
    "smpte432": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), D65),
    "smpte431": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), DCI_WHITE),
    "smpte170m": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), D65),
    "smpte240m": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), D65),
    "bt470bg": ((0.640, 0.330), (0.290, 0.600), (0.150, 0.060), D65),
    "bt470m": ((0.670, 0.330), (0.210, 0.710), (0.140, 0.080), ILLUMINANT_C),
    "jedec-p22": ((0.630, 0.340), (0.295, 0.605), (0.155, 0.077), D65),
}
# --- fixed values: aliases of the tokens above -------------------------------
PRIMARIES_ALIASES = {
    "709": "bt709", "gbr": "bt709", "rgb": "bt709", "srgb": "bt709",
    "2020": "bt2020", "rec2020": "bt2020", "bt2100": "bt2020",
    "p3": "smpte432", "display-p3": "smpte432", "displayp3": "smpte432",
    "dci": "smpte431", "dci-p3": "smpte431",
    "601": "smpte170m", "bt601": "smpte170m",
    "p22": "jedec-p22", "ebu3213": "jedec-p22",
}
