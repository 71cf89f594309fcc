"""Names of telemetry fields."""

# The fields of a log and the column names that stand for each.
FIELDS = {
    "timestamp": [
        "timestamp", "time", "datetime", "date_time", "utc", "utc_time", "gps_time", "gps_timestamp", "unix_time", "unix_timestamp", "epoch", "epoch_time",
        "time_ms", "timestamp_ms", "timestamp_us", "timestamp_usec", "time_us", "time_usec", "time_boot_ms", "time_boot_us", "flight_time", "elapsed_time", "time_s",
    ],
    "latitude": ["latitude", "lat", "gps_latitude", "gps_lat", "latitude_deg", "lat_deg", "latitude_degrees", "lat_degrees", "gps_lat_deg", "gps_latitude_deg", "lat_dd"],
    "longitude": ["longitude", "lon", "lng", "long", "gps_longitude", "gps_lon", "longitude_deg", "lon_deg", "longitude_degrees", "lon_degrees", "gps_lon_deg", "gps_longitude_deg", "lon_dd"],
    "altitude": [
        "altitude", "alt", "gps_altitude", "gps_alt", "altitude_m", "alt_m", "altitude_meter", "altitude_meters", "height", "height_m", "elevation", "elevation_m",
        "gps_height", "global_alt", "global_altitude", "alt_msl", "altitude_msl",
    ],
    "altitude_agl": ["relative_alt", "relative_altitude", "rel_alt", "agl", "height_agl", "relative_alt_m", "alt_relative", "altitude_rel"],
    "roll": ["roll", "roll_deg", "bank", "bank_angle"],
    "pitch": ["pitch", "pitch_deg"],
    "yaw": ["yaw", "yaw_deg", "heading_deg", "course_over_ground"],
    "heading": ["heading", "heading_deg", "compass", "course", "cog"],
    "velocity_x": ["velocity_x", "vx", "vel_x", "speed_north", "vn"],
    "velocity_y": ["velocity_y", "vy", "vel_y", "speed_east", "ve"],
    "velocity_z": ["velocity_z", "vz", "vel_z", "speed_down", "vd"],
    "speed": ["speed", "speed_kmh", "speed_mph", "ground_speed", "gs"],
    "gps_accuracy": ["gps_accuracy", "accuracy", "pos_accuracy", "eph"],
    "horizontal_accuracy": ["horizontal_accuracy", "h_acc", "hacc", "acc_h"],
    "vertical_accuracy": ["vertical_accuracy", "v_acc", "vacc", "acc_v"],
    "satellites": ["satellites", "sats", "num_sats", "sat", "satellites_visible"],
    "hdop": ["hdop", "h_dop"],
    "vdop": ["vdop", "v_dop"],
    "frame_number": ["frame_number", "frame", "frame_id", "frame_idx", "fn"],
    "sequence": ["sequence", "seq", "sample_number", "index", "row"],
}

# The order in which fields choose their column; words that are units; words of camera poses; delimiters.
CHOICE = [
    "latitude", "longitude", "altitude_agl", "altitude", "timestamp", "heading", "yaw", "roll", "pitch", "velocity_x", "velocity_y", "velocity_z", "speed",
    "gps_accuracy", "horizontal_accuracy", "vertical_accuracy", "satellites", "hdop", "vdop", "frame_number", "sequence",
]
UNITS = ["deg", "degree", "degrees", "m", "meter", "meters", "ft", "feet", "ms", "millis", "milliseconds", "us", "usec", "micros", "microseconds", "s", "sec", "secs", "seconds", "kmh", "kph", "mph"]
POSE_WORDS = ["qw", "qx", "qy", "qz", "quat", "quaternion", "fov", "focal", "cx", "cy", "intrinsics"]
DELIMITERS = [",", ";", "\t", "|"]
