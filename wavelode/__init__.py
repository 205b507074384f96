"""Audio-bitstream analytics and training-data operators on Spark."""
