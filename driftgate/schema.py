"""Explicit schemas of the persisted tables."""

from pyspark.sql import types as T

LATENT = T.StructType([
    T.StructField("factory_id", T.StringType()),
    T.StructField("worker_id", T.StringType()),
    T.StructField("video_index", T.IntegerType()),
    T.StructField("tubelet_start", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("m_flow", T.FloatType()),
    T.StructField("latent_bytes", T.BinaryType()),
])

LATENT_KEYS = ["factory_id", "worker_id", "video_index", "tubelet_start"]

ROW_ADDRESS = ["file_path", "row_index"]

PSI_STATS = T.StructType([
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("p20", T.DoubleType()),
    T.StructField("p50", T.DoubleType()),
    T.StructField("p80", T.DoubleType()),
])

CALIBRATION = T.StructType([
    T.StructField("epsilon_noise_floor", T.DoubleType()),
    T.StructField("tau_kinetic_gate", T.DoubleType()),
    T.StructField("samples_used_for_epsilon", T.LongType()),
    T.StructField("samples_used_for_tau", T.LongType()),
    T.StructField("psi_stats", PSI_STATS),
])
