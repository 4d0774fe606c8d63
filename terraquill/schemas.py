"""Declared schemas of the entities."""

DETECTIONS = "image_id long, det_idx long, label string, score double"
BOXES = "image_name string, boxes array<array<double>>, scores array<double>, labels array<string>"
PIXELS = "image_name string, det_idx int, x int, y int, v double"
LOCATIONS = "image_id long, det_idx long, object string, position string"
OBSERVATIONS = "model_ord long, model_key string, image string, inference_time double, overall double, keyword_count long, error string"
MESSAGES = "array<struct<role:string,content:array<struct<type:string,image:string,text:string>>>>"
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
