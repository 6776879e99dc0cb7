"""They must equal the published ones for results to agree."""

# Hourly occupancy share, weekday and weekend, hours 0..23.
HOUR_PATTERNS = {
    "Public": {
        "weekday": [0.2, 0.1, 0.05, 0.05, 0.1, 0.3, 0.5, 0.8, 0.9, 0.7, 0.6, 0.7,
                    0.8, 0.7, 0.6, 0.7, 0.9, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2],
        "weekend": [0.1, 0.05, 0.05, 0.05, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9,
                    1.0, 0.9, 0.8, 0.7, 0.6, 0.7, 0.8, 0.7, 0.5, 0.4, 0.3, 0.2],
    },
    "Resident": {
        "weekday": [0.8, 0.9, 0.95, 0.95, 0.9, 0.8, 0.6, 0.4, 0.3, 0.2, 0.2, 0.3,
                    0.4, 0.4, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.9, 0.9, 0.9, 0.8],
        "weekend": [0.8, 0.9, 0.95, 0.95, 0.9, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.4,
                    0.5, 0.5, 0.5, 0.6, 0.7, 0.8, 0.8, 0.9, 0.9, 0.9, 0.9, 0.8],
    },
}

# Comfort temperature (optimum, seasonal offsets, width) of the rule model ...
COMFORT = {"optimal": 22.0, "winter": -5.0, "summer": 5.0, "width": 10.0}
# ... and of the smooth model, which also damps the effect by a weight.
SMOOTH_COMFORT = {"optimal": 22.0, "winter": -3.0, "summer": 2.0, "width": 5.0, "weight": 0.4}

# Traffic level of the rule model: base, weekday / weekend factors, peaks (start, end, factor).
TRAFFIC = {"base": 0.5, "weekday": 1.2, "weekend": 0.8, "peaks": [(7, 9, 1.5), (16, 19, 1.4)]}

# City centre (latitude, longitude) and reach of its influence in km.
CENTRE = (41.3851, 2.1734)
CENTRE_REACH_KM = 10.0

# Zones as (name, latitude, longitude, radius in degrees, sensitivity).
ZONES = [
    ("business_district", 41.3874, 2.1686, 0.01, 1.5),
    ("tourist_area", 41.3851, 2.1734, 0.008, 1.3),
    ("residential", 41.4034, 2.1744, 0.015, 0.7),
    ("shopping_district", 41.3937, 2.1647, 0.012, 1.2),
    ("beach_area", 41.3751, 2.1925, 0.01, 0.9),
]

# Capacity factor by facility type.
TYPE_FACTORS = {"Public": 1.0, "Resident": 0.9, "Mixed": 0.95}

# Labels of availability levels.
LEVELS = {
    0: "No prediction",
    1: "High availability (>80%)",
    2: "Medium availability (30-80%)",
    3: "Low availability (<10%)",
}
