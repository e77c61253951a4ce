"""Where grids come from and go to: the Parquet store, its bounds index, source granules, chunked arrays and tide documents."""
