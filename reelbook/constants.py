"""Texts, formats and sizes the results depend on."""

# File suffixes of recordings (case-sensitive).
VIDEO_SUFFIXES = [".mp4", ".MP4", ".MOV", ".mov", ".avi", ".mkv"]

# Camera-part file names, two digits of part and four of recording.
PART_PATTERN = r"^GX(\d{2})(\d{4})\.MP4$"
PART_FORMAT = "GX%02d%04d.MP4"
EDIT_DOCUMENT_NAME_FORMAT = "VID00%d.json"

# Texts of titles, descriptions and publish bodies.
TITLE_SUFFIX = "[JUGGER]"
REFEREE_LINE = "Refered by : "
PUBLISH_TAGS = ["jugger", "tournament", "sport"]
PUBLISH_CATEGORY = "17"

# Kinds, statuses and cut types.
VIDEO_KIND = "youtube#video"
PUBLIC, UNLISTED, PRIVATE, SCHEDULED = "public", "unlisted", "private", "scheduled"
CUT_TYPES = ["MAN", "VID", "XML", "ML", "X"]

# Sub-directories of a tournament's source directory.
RENDERED_DIR, TIMELINES_DIR, RUSHS_DIR = "rendered", "timelines", "rushs"

# Edges of the image retention window and of the catalogue ingest.
RETENTION_START = "2011-01-01"
CATALOGUE_START = "2023-12-10"

# Thumbnail geometry in pixels.
FRAME_WIDTH, FRAME_HEIGHT = 1920, 1080
OVERLAY_WIDTH = 600
LOGO_SIDE = 850
LOGO1_CENTRE = (300, 270)
LOGO2_CENTRE = (450, 810)
TITLE_MARGIN, TITLE_TOP = 80, 600
ZOOM_MIN, ZOOM_MAX = 1.0, 5.0

# Longest texts the fields accept.
MAX_LENGTHS = {
    "tournaments": {"name": 100, "short_name": 14, "place": 200, "JTR": 200, "tugeny_link": 200, "color": 25, "source_dir": 200, "slug": 50},
    "teams": {"name": 100, "slug": 50},
    "games": {"name": 100, "source_name": 100, "rendered": 200, "slug": 50},
    "cuts": {"name": 100, "type_cut": 50, "slug": 50},
    "team_logos": {"name": 100, "short_name": 10},
    "tmp_images": {"name": 100},
    "video_metadata": {"name": 100, "video_name": 120, "description": 5000},
    "yt_videos": {"title": 150, "video_id": 50, "privacy_status": 150},
}

# Fields that may not be empty.
REQUIRED = {
    "tournaments": ["name", "short_name", "date"],
    "teams": ["name"],
    "games": ["name", "source_name", "tournament"],
    "cuts": ["name", "type_cut"],
    "team_logos": ["name", "short_name"],
    "tmp_images": ["name"],
    "video_metadata": ["name", "video_name", "description", "publication_date", "team1", "team2"],
    "yt_videos": ["video_id"],
}

# Fields unique together; nulls never clash.
UNIQUE = {"video_metadata": ["name", "tournament"], "yt_videos": ["video_id"]}

# What a new row takes where no value is given.
DEFAULTS = {
    "tournaments": {"place": "", "JTR": "", "tugeny_link": "", "color": "#0000", "source_dir": "-", "slug": ""},
    "teams": {"slug": ""},
    "games": {"rendered": "", "json_file": "tt", "source_proxy": "", "slug": ""},
    "cuts": {"json_file": "tt", "slug": ""},
    "team_logos": {"image": "default.png"},
    "tmp_images": {"image": "default.png"},
    "video_metadata": {
        "time_code": 0, "miniature_x_offset": 0, "miniature_y_offset": 0, "miniature_zoom": 1, "video_name": "", "description": "",
    },
    "yt_videos": {"title": "", "privacy_status": ""},
}

# Fields that take the clock, to the moment or to the day.
CLOCK_DEFAULTS = {"tmp_images": {"date": "day"}, "video_metadata": {"publication_date": "moment"}, "yt_videos": {"publication_date": "day"}}

# Foreign keys, as (field, referenced table, what a deleted target does).
FOREIGN_KEYS = {
    "teams": [("logo", "team_logos", "keep")],
    "games": [("tournament", "tournaments", "cascade"), ("team1", "teams", "null"), ("team2", "teams", "null")],
    "cuts": [("game", "games", "null")],
    "video_metadata": [
        ("tournament", "tournaments", "null"),
        ("base_image", "tmp_images", "null"),
        ("miniature_image", "tmp_images", "null"),
        ("team1", "team_logos", "null"),
        ("team2", "team_logos", "null"),
    ],
    "yt_videos": [("linked_video", "video_metadata", "null")],
}
