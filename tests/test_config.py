"""What the two processes make of their environments."""

from tidemark import config
from tidemark.sources.sampler import options_of

ENVIRONMENTS = {
    "plain": {"CLUSTER_ID": "main", "STORE": "/data", "SCALER_ADDRESSES": "a:1, b:2,a:1"},
    "own": {"CLUSTER_ID": " east ", "STORE": "s", "SCALER_ADDRESSES": "a:1", "RECOVERY_INTERVAL": "1m30s", "RECOVERY_ENABLED": "false", "MAX_RETRIES": "0", "JITTER_WINDOW": "500ms", "MIN_TRAINING_WINDOW": "36h"},
    "no cluster": {"STORE": "s"},
    "no scaler": {"CLUSTER_ID": "c", "STORE": "s", "SCALER_ADDRESSES": " , ", "MAX_RETRIES": "-1"},
    "bad": {"CLUSTER_ID": "c", "STORE": "s", "SCALER_ADDRESSES": "a:1", "RECOVERY_INTERVAL": "0s", "MAX_CONCURRENT": "0"},
}
FAULTS = {
    ("no cluster", "control"): "TIDEMARK_CLUSTER_ID is required",
    ("no cluster", "sampling"): "TIDEMARK_CLUSTER_ID is required",
    ("no scaler", "control"): "TIDEMARK_SCALER_ADDRESSES must name at least one",
    ("no scaler", "sampling"): "TIDEMARK_MAX_RETRIES must be a whole number of 0 at least",
    ("bad", "control"): "TIDEMARK_RECOVERY_INTERVAL must be a positive duration",
    ("bad", "sampling"): "TIDEMARK_MAX_CONCURRENT must be a whole number of 1 at least",
}


def loaded(name, settings):
    values = ENVIRONMENTS[name]
    return config.load(settings, lambda key: values.get(key.removeprefix(config.PREFIX)))


def test_environments():
    faults = {}
    for name in ENVIRONMENTS:
        for process, settings in (("control", config.CONTROL), ("sampling", config.SAMPLING)):
            try:
                loaded(name, settings)
            except ValueError as e:
                faults[name, process] = str(e)
    assert faults == FAULTS
    plain, own = loaded("plain", config.CONTROL), loaded("own", config.CONTROL)
    assert (plain["cluster_id"], list(plain["scaler_addresses"]), plain["recovery_interval"], plain["min_training_window"], plain["recovery_enabled"]) == ("main", ["a:1", "b:2"], 30.0, 604800.0, True)
    assert (own["cluster_id"], list(own["scaler_addresses"]), own["recovery_interval"], own["min_training_window"], own["recovery_enabled"]) == ("east", ["a:1"], 90.0, 129600.0, False)


def test_settings_drive_the_sampler():
    assert options_of(loaded("plain", config.SAMPLING)) == {"concurrent": 8, "tries": 3, "backoff": 0.5, "timeout": 10.0, "jitter": 15}
    assert options_of(loaded("own", config.SAMPLING)) == {"concurrent": 8, "tries": 1, "backoff": 0.5, "timeout": 10.0, "jitter": 1}
